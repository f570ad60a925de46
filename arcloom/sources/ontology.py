"""The ontology: domains with entity and relation types, their catalog, file storage and managed versions."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

from ..errors import GraphError, Unsupported
from ..functions.types import storage_type

SCOPES = ("text", "table", "structured")


@dataclass
class PropertySpec:
    name: str
    type: str = "Keyword"
    description: str = ""
    required: bool = False
    allowed_values: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, d: Mapping[str, Any]) -> PropertySpec:
        return cls(d["name"], storage_type(d.get("property_type") or d.get("type") or "Keyword"), d.get("description") or "", bool(d.get("required")), list(d.get("allowed_values") or []))

    def to_json(self) -> dict:
        out: dict[str, Any] = {"name": self.name, "property_type": self.type}
        if self.description:
            out["description"] = self.description
        if self.required:
            out["required"] = True
        if self.allowed_values:
            out["allowed_values"] = self.allowed_values
        return out


@dataclass
class TypeSpec:
    """An entity type or a relation type."""

    name: str
    description: str = ""
    properties: list[PropertySpec] = field(default_factory=list)

    @classmethod
    def of(cls, d: Mapping[str, Any]) -> TypeSpec:
        return cls(d["name"], d.get("description") or "", [PropertySpec.of(p) for p in d.get("properties") or []])

    def property(self, name: str) -> PropertySpec | None:
        return next((p for p in self.properties if p.name == name), None)

    def to_json(self) -> dict:
        return {"name": self.name, "description": self.description, "properties": [p.to_json() for p in self.properties]}


@dataclass
class Domain:
    description: str = ""
    entity_types: list[TypeSpec] = field(default_factory=list)
    relation_types: list[TypeSpec] = field(default_factory=list)

    @classmethod
    def of(cls, d: Mapping[str, Any]) -> Domain:
        return cls(d.get("description") or "", [TypeSpec.of(x) for x in d.get("entity_types") or []], [TypeSpec.of(x) for x in d.get("relation_types") or []])

    def entity(self, name: str) -> TypeSpec | None:
        return next((t for t in self.entity_types if t.name == name), None)

    def relation(self, name: str) -> TypeSpec | None:
        return next((t for t in self.relation_types if t.name == name), None)

    def to_json(self) -> dict:
        return {"description": self.description, "entity_types": [t.to_json() for t in self.entity_types], "relation_types": [t.to_json() for t in self.relation_types]}


@dataclass
class Ontology:
    """All domains by name; small, and kept on the driver."""

    domains: dict[str, Domain] = field(default_factory=dict)

    @classmethod
    def of(cls, d: Mapping[str, Any]) -> Ontology:
        return cls({name: Domain.of(x) for name, x in d.items()})

    def to_json(self) -> dict:
        return {name: self.domains[name].to_json() for name in sorted(self.domains)}

    def entity(self, name: str) -> tuple[str, TypeSpec] | None:
        for domain in sorted(self.domains):
            if t := self.domains[domain].entity(name):
                return domain, t
        return None

    def relation(self, name: str) -> tuple[str, TypeSpec] | None:
        for domain in sorted(self.domains):
            if t := self.domains[domain].relation(name):
                return domain, t
        return None

    def property(self, label: str, name: str) -> PropertySpec | None:
        """Of an entity type, or else of a relation type."""
        for found in (self.entity(label), self.relation(label)):
            if found and (p := found[1].property(name)):
                return p
        return None

    def field_types(self) -> dict[tuple[str, str], str]:
        """(label, property) to storage type; entity types win over relation types."""
        out: dict[tuple[str, str], str] = {}
        for domain in sorted(self.domains):
            d = self.domains[domain]
            for t in [*d.entity_types, *d.relation_types]:
                for p in t.properties:
                    out.setdefault((t.name, p.name), p.type)
        return out

    def merge(self, other: Ontology) -> None:
        """Types and properties of other are added; what is there already stays."""
        for name, d in other.domains.items():
            mine = self.domains.setdefault(name, Domain(d.description))
            for kind in ("entity_types", "relation_types"):
                have = {t.name: t for t in getattr(mine, kind)}
                for t in getattr(d, kind):
                    if t.name not in have:
                        getattr(mine, kind).append(TypeSpec(t.name, t.description, list(t.properties)))
                        continue
                    known = {p.name for p in have[t.name].properties}
                    have[t.name].properties += [p for p in t.properties if p.name not in known]

    def domain_text(self, name: str) -> str:
        """What a domain is embedded as, to route questions to it."""
        d = self.domains[name]
        lines = [f"domain: {name}"] + ([d.description] if d.description else [])
        lines += [f"{t.name}: {t.description} ({', '.join(p.name for p in t.properties)})" for t in d.entity_types]
        lines += [f"{t.name}: {t.description}" for t in d.relation_types]
        return "\n".join(lines)

    def route(self, question: str, embedder: Any, top_k: int = 3, threshold: float = 0.45, among: Iterable[str] | None = None) -> list[tuple[str, float]]:
        """The domains nearest to a question."""
        names = sorted(set(self.domains) & set(among) if among is not None else self.domains)
        if not names:
            return []
        v = embedder.embed([question, *[self.domain_text(n) for n in names]])
        scores = v[1:] @ v[0]
        ranked = sorted(zip(names, scores.tolist()), key=lambda x: (-x[1], x[0]))
        return [(n, s) for n, s in ranked[:top_k] if s >= threshold]


class Storage(Protocol):
    def load(self) -> dict: ...

    def save(self, doc: dict) -> None: ...


class FileStorage:
    """One JSON file, rewritten as a whole: readers see the old or the new one."""

    def __init__(self, path: str):
        self.path = Path(path)

    def load(self) -> dict:
        return json.loads(self.path.read_text(encoding="utf-8")) if self.path.exists() else {}

    def save(self, doc: dict) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(dir=self.path.parent, prefix=self.path.name)
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(doc, f, ensure_ascii=False, indent=2, sort_keys=True)
        os.replace(name, self.path)


class ReadOnlyStorage:
    def __init__(self, doc: dict):
        self.doc = doc

    def load(self) -> dict:
        return self.doc

    def save(self, doc: dict) -> None:
        raise Unsupported("this ontology cannot be changed")


class VersionConflict(GraphError):
    """The domain has changed since it was read."""


class OntologyService:
    """Managed domains: each change names the version it rests on, if it cares, and makes a new one."""

    def __init__(self, storage: Storage):
        self.storage = storage

    def _state(self) -> dict:
        return self.storage.load()

    def names(self) -> list[str]:
        return sorted(self._state())

    def get(self, name: str) -> tuple[Domain, int]:
        state = self._state()
        if name not in state:
            raise GraphError(f"no domain {name!r}")
        return Domain.of(state[name]["ontology"]), state[name]["version"]

    def create(self, name: str, domain: Mapping[str, Any]) -> int:
        state = self._state()
        if name in state:
            raise GraphError(f"domain {name!r} is there already")
        state[name] = {"ontology": Domain.of(domain).to_json(), "version": 1}
        self.storage.save(state)
        return 1

    def replace(self, name: str, domain: Mapping[str, Any], version: int | None = None) -> int:
        return self._change(name, lambda _: Domain.of(domain), version)

    def patch(self, name: str, addition: Mapping[str, Any], version: int | None = None) -> int:
        """Adds types and properties; nothing is taken away or changed."""

        def add(old: Domain) -> Domain:
            o = Ontology({name: old})
            o.merge(Ontology({name: Domain.of(addition)}))
            return o.domains[name]

        return self._change(name, add, version)

    def rename(self, name: str, new: str) -> None:
        state = self._state()
        if name not in state:
            raise GraphError(f"no domain {name!r}")
        if new in state:
            raise GraphError(f"domain {new!r} is there already")
        state[new] = state.pop(name)
        state[new]["version"] += 1
        self.storage.save(state)

    def delete(self, name: str) -> None:
        state = self._state()
        if state.pop(name, None) is None:
            raise GraphError(f"no domain {name!r}")
        self.storage.save(state)

    def import_all(self, doc: Mapping[str, Any]) -> list[str]:
        """Creates or replaces every domain of a document."""
        for name, d in doc.items():
            if name in self._state():
                self.replace(name, d)
            else:
                self.create(name, d)
        return sorted(doc)

    def refresh(self, introspected: Ontology, collect_garbage: bool = False) -> list[str]:
        """Adds what the live graph has; with collection, drops types and domains that it lacks."""
        for name, d in introspected.domains.items():
            if name in self._state():
                self.patch(name, d.to_json())
            else:
                self.create(name, d.to_json())
        if collect_garbage:
            for name in self.names():
                if name not in introspected.domains:
                    self.delete(name)
                    continue
                live = introspected.domains[name]

                def keep(old: Domain, live: Domain = live) -> Domain:
                    return Domain(old.description, [t for t in old.entity_types if live.entity(t.name)], [t for t in old.relation_types if live.relation(t.name)])

                self._change(name, keep, None)
        return self.names()

    def ontology(self) -> Ontology:
        return Ontology({name: Domain.of(x["ontology"]) for name, x in self._state().items()})

    def _change(self, name: str, make: Any, version: int | None) -> int:
        state = self._state()
        if name not in state:
            raise GraphError(f"no domain {name!r}")
        have = state[name]["version"]
        if version is not None and version != have:
            raise VersionConflict(f"domain {name!r} is at version {have}, not {version}")
        state[name] = {"ontology": make(Domain.of(state[name]["ontology"])).to_json(), "version": have + 1}
        self.storage.save(state)
        return have + 1
