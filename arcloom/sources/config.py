"""Configuration: a TOML file under environment variables, which win."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from ..operators.resolve import ResolveConfig
from ..plans.dsl import Settings

PREFIX = "ARCLOOM"


@dataclass(frozen=True)
class Config:
    query: Settings = field(default_factory=Settings)
    resolve: ResolveConfig = field(default_factory=ResolveConfig)
    prefix_label: str | None = None
    store_path: str | None = None


def _typed(old: Any, raw: Any) -> Any:
    if isinstance(raw, str) and not isinstance(old, str):
        if isinstance(old, bool):
            return raw.strip().lower() in ("1", "true", "yes", "on")
        if isinstance(old, int):
            return int(raw)
        if isinstance(old, float):
            return float(raw)
        if isinstance(old, tuple):
            return tuple(x.strip() for x in raw.split(",") if x.strip())
    if isinstance(old, tuple) and isinstance(raw, list):
        return tuple(raw)
    return raw


def load(path: str | None = None, env: Mapping[str, str] | None = None) -> Config:
    """Sections [query], [resolve] and [graph]; ARCLOOM__SECTION__FIELD overrides a field. Other names are ignored."""
    env = os.environ if env is None else env
    doc = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    cfg = Config()

    def section(name: str, base: Any) -> Any:
        given = dict(doc.get(name) or {})
        for f in fields(base):
            key = f"{PREFIX}__{name.upper()}__{f.name.upper()}"
            if key in env:
                given[f.name] = env[key]
        return replace(base, **{f.name: _typed(getattr(base, f.name), given[f.name]) for f in fields(base) if f.name in given})

    graph = dict(doc.get("graph") or {})
    for f in ("prefix_label", "store_path"):
        if f"{PREFIX}__GRAPH__{f.upper()}" in env:
            graph[f] = env[f"{PREFIX}__GRAPH__{f.upper()}"]
    return replace(cfg, query=section("query", cfg.query), resolve=section("resolve", cfg.resolve), prefix_label=graph.get("prefix_label"), store_path=graph.get("store_path"))
