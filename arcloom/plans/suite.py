"""Answer suites: questions with a query each, and what their rows must be."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

Row = Mapping[str, Any]


def _same(a: Any, b: Any) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return a == b


def _text(rows: Sequence[Row]) -> str:
    return json.dumps([dict(r) for r in rows], ensure_ascii=False, default=str).lower()


def _numbers(v: Any) -> list[float]:
    if isinstance(v, bool):
        return []
    if isinstance(v, (int, float)):
        return [float(v)]
    if isinstance(v, Mapping):
        return [x for y in v.values() for x in _numbers(y)]
    return [x for y in v for x in _numbers(y)] if isinstance(v, (list, tuple)) else []


def check(rows: Sequence[Row], columns: Sequence[str], rules: Mapping[str, Any], query: Mapping[str, Any] | None = None, answer: str | None = None, judge: Callable[[str, Any], bool] | None = None) -> list[str]:
    """What is wrong with rows, by the rules given; nothing if all hold.

    row_count {exact, min, max}; rows: each must be contained in one of the
    result, in any order; columns: must be there; contains and not_contains:
    texts, whatever the case; numbers: must occur; answer_contains; dsl_expect:
    keys of the query with the value they must have; judge: left to a callable.
    """
    bad = []
    n = rules.get("row_count") or {}
    if isinstance(n, int):
        n = {"exact": n}
    for key, ok in (("exact", lambda x: len(rows) == x), ("min", lambda x: len(rows) >= x), ("max", lambda x: len(rows) <= x)):
        if n.get(key) is not None and not ok(n[key]):
            bad.append(f"{len(rows)} rows, not {key} {n[key]}")
    left = list(rows)
    for want in rules.get("rows") or []:
        hit = next((r for r in left if all(k in r and _same(r[k], v) for k, v in want.items())), None)
        if hit is None:
            bad.append(f"no row {want}")
        else:
            left.remove(hit)
    bad += [f"no column {c!r}" for c in rules.get("columns") or [] if c not in columns]
    text = _text(rows)
    bad += [f"{t!r} is not in the rows" for t in rules.get("contains") or [] if str(t).lower() not in text]
    bad += [f"{t!r} is in the rows" for t in rules.get("not_contains") or [] if str(t).lower() in text]
    have = _numbers([dict(r) for r in rows])
    bad += [f"no number {x}" for x in rules.get("numbers") or [] if not any(_same(float(x), y) for y in have)]
    bad += [f"{t!r} is not in the answer" for t in rules.get("answer_contains") or [] if str(t).lower() not in (answer or "").lower()]
    for key, want in (rules.get("dsl_expect") or {}).items():
        if (query or {}).get(key) != want:
            bad.append(f"the query has {key} {(query or {}).get(key)!r}, not {want!r}")
    if rules.get("judge") is not None and judge is not None and not judge(answer or text, rules["judge"]):
        bad.append("the judge says no")
    return bad


@dataclass(frozen=True)
class Outcome:
    id: str
    ok: bool
    faults: tuple[str, ...]


def run_suite(questions: Sequence[Mapping[str, Any]], run: Callable[[Mapping[str, Any]], DataFrame]) -> list[Outcome]:
    """Runs the query of every question and checks its rows; a query that fails is a fault."""
    out = []
    for item in questions:
        try:
            df = run(item["dsl"])
            rows = [r.asDict(recursive=True) for r in df.collect()]
            faults = check(rows, df.columns, item.get("validation") or {}, item["dsl"])
        except Exception as e:  # noqa: BLE001 - the fault is the result
            faults = [f"{type(e).__name__}: {e}"]
        out.append(Outcome(item["id"], not faults, tuple(faults)))
    return out
