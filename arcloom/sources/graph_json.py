"""Graph documents: parsing, a fluent builder, and their rows as DataFrames.

A document is `{source?, entities: [...], relations: [...]}`.  Properties are
raw JSON, whose kind is inferred, or `{type, value}`.  With a source, entities
get a `mention` edge to it and chunks a `part_of` edge.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FieldTypeError, IngestError
from ..functions.types import INGEST_HANDLER, STORAGE_ALIASES, Registry, storage_type
from .ontology import SCOPES

CANONICAL = "_canonical"
_ENTITY_KEYS = {"id", "type", "label", "labels", "scopes", "scope", "primary_key", "properties", "domain"}
_RELATION_KEYS = {"from", "to", "type", "properties"}
ENTITY_SCHEMA = "idx long, local_id string, type string, domain string, scopes array<string>, key_field string, soft boolean, key string, props map<string,string>"
RELATION_SCHEMA = "idx long, rel string, from_id string, to_id string, props map<string,string>"


@dataclass
class Prop:
    type: str
    value: Any


@dataclass
class Entity:
    id: str
    type: str
    props: dict[str, Prop] = field(default_factory=dict)
    scopes: tuple[str, ...] = ()
    domain: str | None = None
    strict: str | None = None  # key property; None: the canonical text
    reference: bool = False  # only names a node that is stored already


@dataclass
class Relation:
    source: str
    target: str
    type: str
    props: dict[str, Prop] = field(default_factory=dict)


@dataclass
class Graph:
    entities: list[Entity] = field(default_factory=list)
    relations: list[Relation] = field(default_factory=list)


def infer_storage(v: Any) -> str:
    if isinstance(v, bool):
        return "Bool"
    return "Number" if isinstance(v, (int, float)) else "Text"


def _prop(v: Any) -> Prop:
    if isinstance(v, Mapping) and set(v) == {"type", "value"} and str(v["type"]).lower() in STORAGE_ALIASES:
        return Prop(storage_type(v["type"]), v["value"])
    return Prop(infer_storage(v), v)


def canonical_of(entity_type: str, props: Mapping[str, Prop]) -> str:
    """`type: T` and a line for each text property, by name."""
    lines = [f"type: {entity_type}"]
    for k in sorted(props):
        p = props[k]
        if p.type == "Text" and k not in ("id", CANONICAL) and p.value is not None:
            lines.append(f"{k}: {p.value if isinstance(p.value, str) else json.dumps(p.value, ensure_ascii=False)}")
    return "\n".join(lines)


def parse_graph(doc: str | Mapping[str, Any]) -> Graph:
    d = json.loads(doc) if isinstance(doc, str) else doc
    b = GraphBuilder()
    source = d.get("source")
    if source is not None:
        b.source(source["name"] if isinstance(source, Mapping) else source)
    for e in d.get("entities") or []:
        if "type" not in e or "id" not in e:
            raise IngestError("an entity needs id and type")
        props = {k: _prop(v) for k, v in (e.get("properties") or {}).items()}
        props |= {k: _prop(v) for k, v in e.items() if k not in _ENTITY_KEYS}
        pk = e.get("primary_key")
        strict = pk.get("strict") if isinstance(pk, Mapping) else pk
        if isinstance(pk, Mapping) and "soft" in pk:
            strict = None
        scopes = tuple(e.get("scopes") or ([e["scope"]] if e.get("scope") else ()))
        b.entity(str(e["id"]), e["type"], props, strict=strict, scopes=scopes, domain=e.get("domain"))
    for r in d.get("relations") or d.get("relationships") or []:
        if not all(k in r for k in ("from", "to", "type")):
            raise IngestError("a relation needs from, to and type")
        props = {k: _prop(v) for k, v in (r.get("properties") or {}).items()}
        props |= {k: _prop(v) for k, v in r.items() if k not in _RELATION_KEYS}
        b.relationship(str(r["from"]), r["type"], str(r["to"]), props)
    return b.build()


class GraphBuilder:
    """Entities, chunks and relationships by calls that can be chained."""

    def __init__(self, scope: str | None = None):
        self._graph, self._ids, self._source, self._scope = Graph(), set(), None, scope

    def source(self, name: str) -> GraphBuilder:
        self._add(Entity(f"source:{name}", "Source", {"name": Prop("Keyword", name)}, strict="name"))
        self._source = f"source:{name}"
        return self

    def entity(self, id: str, type: str, props: Mapping[str, Any] | None = None, *, strict: str | None = None, scopes: tuple[str, ...] = (), domain: str | None = None) -> GraphBuilder:
        made = {k: v if isinstance(v, Prop) else _prop(v) for k, v in (props or {}).items()}
        made.setdefault("id", Prop("Keyword", id))
        for s in scopes:
            if s not in SCOPES:
                raise IngestError(f"unknown scope {s!r}")
        if type == "Chunk":
            if self._source is None:
                raise IngestError("a chunk needs a source")
            strict = strict or "id"
        self._add(Entity(id, type, made, scopes or ((self._scope,) if self._scope else ()), domain, strict))
        if self._source and type != "Source":
            self._graph.relations.append(Relation(id, self._source, "part_of" if type == "Chunk" else "mention"))
        return self

    def chunk(self, id: str, text: str, order: int = 0, **props: Any) -> GraphBuilder:
        return self.entity(id, "Chunk", {"chunk_id": Prop("Keyword", id), "order": Prop("Number", order), "text": Prop("Text", text), **props})

    def reference(self, id: str, type: str, field_: str, value: Any) -> GraphBuilder:
        """An end for relationships that is stored already: matched by its key, not written."""
        self._add(Entity(id, type, {field_: Prop("Keyword", value)}, strict=field_, reference=True))
        return self

    def relationship(self, source: str, type: str, target: str, props: Mapping[str, Any] | None = None) -> GraphBuilder:
        for end in (source, target):
            if end not in self._ids:
                raise IngestError(f"relation end {end!r} is no entity of this graph")
        self._graph.relations.append(Relation(source, target, type, {k: v if isinstance(v, Prop) else _prop(v) for k, v in (props or {}).items()}))
        return self

    def _add(self, e: Entity) -> None:
        if e.id in self._ids:
            raise IngestError(f"entity {e.id!r} is there twice")
        self._ids.add(e.id)
        if e.type != "Chunk" and not e.reference:
            e.props.setdefault(CANONICAL, Prop("Text", canonical_of(e.type, e.props)))
        self._graph.entities.append(e)

    def build(self) -> Graph:
        return self._graph


def stored(name: str, p: Prop, registry: Registry) -> str | None:
    """A property's value as JSON text, or None if it is not stored."""
    try:
        got = registry.get(INGEST_HANDLER[p.type]).parse(p.value)
    except FieldTypeError as e:
        if p.type == "Text":
            # text of another shape is kept as it is written
            return json.dumps(json.dumps(p.value, ensure_ascii=False), ensure_ascii=False)
        raise IngestError(f"property {name!r}: {e}") from e
    return None if got is None else json.dumps(got, ensure_ascii=False)


def entity_rows(g: Graph, registry: Registry, start: int = 0) -> Iterator[tuple]:
    for i, e in enumerate(g.entities):
        props = {k: v for k, p in e.props.items() if (v := stored(k, p, registry)) is not None}
        key_field = e.strict or CANONICAL
        if key_field not in props or json.loads(props[key_field]) in ("", None):
            raise IngestError(f"entity {e.id!r} has no value for its key {key_field!r}")
        value = json.loads(props[key_field])
        yield (start + i, e.id, e.type, e.domain, sorted(set(e.scopes)), key_field, e.strict is None, value if isinstance(value, str) else json.dumps(value), None if e.reference else props)


def relation_rows(g: Graph, registry: Registry, start: int = 0) -> Iterator[tuple]:
    for i, r in enumerate(g.relations):
        # relation text is stored like a keyword: it makes no embedding
        props = {k: v for k, p in r.props.items() if (v := stored(k, Prop("Keyword" if p.type == "Text" else p.type, p.value), registry)) is not None}
        yield (start + i, r.type, r.source, r.target, props)


def to_frames(spark: SparkSession, g: Graph, registry: Registry | None = None) -> tuple[DataFrame, DataFrame]:
    """Entity and relation rows of one document."""
    registry = registry or Registry()
    return (
        spark.createDataFrame(list(entity_rows(g, registry)), ENTITY_SCHEMA),
        spark.createDataFrame(list(relation_rows(g, registry)), RELATION_SCHEMA),
    )


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entity and relation rows of all documents under a path, parsed in the tasks; ids are made unique by file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, v in zip(pdf["path"], pdf["value"]):
                rows = [(i, f"{p}#{x}", *rest) for i, x, *rest in entity_rows(parse_graph(v), Registry())]
                yield pd.DataFrame(rows, columns=["idx", "local_id", "type", "domain", "scopes", "key_field", "soft", "key", "props"])

    def relations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, v in zip(pdf["path"], pdf["value"]):
                rows = [(i, rel, f"{p}#{a}", f"{p}#{b}", props) for i, rel, a, b, props in relation_rows(parse_graph(v), Registry())]
                yield pd.DataFrame(rows, columns=["idx", "rel", "from_id", "to_id", "props"])

    return files.mapInPandas(entities, ENTITY_SCHEMA), files.mapInPandas(relations, RELATION_SCHEMA)
