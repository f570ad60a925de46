"""The query documents: dataclasses, parsing, validation, description, rewrites.

A document is JSON: a start node, traversals, filters joined by AND, returned
fields, group keys, sort keys, limit and distinct.  Unknown keys are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from ..errors import QueryError

IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
OP_NAME = re.compile(r"[A-Za-z0-9_]+\Z")
DIRECTIONS = ("out", "in", "both")
AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")
DATE_PARTS = ("year", "quarter", "month", "day", "hour")
PLAIN_OPS = (
    "eq", "neq", "gt", "gte", "lt", "lte", "in", "contains", "starts_with", "ends_with",
    "eq_ci", "neq_ci", "in_ci", "contains_ci", "starts_with_ci", "ends_with_ci",
)
HIDDEN_PROPERTIES = ("_canonical", "entity_id", "primary_key")


@dataclass(frozen=True)
class NodePattern:
    alias: str
    label: str = ""


@dataclass(frozen=True)
class Hop:
    source: str
    edge_label: str
    edge_alias: str | None
    direction: str
    target: NodePattern
    depth: tuple[int, int] | None = None
    optional: bool = False

    @property
    def rels(self) -> list[str]:
        return self.edge_label.split("|") if self.edge_label else []


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any = None
    type: str | None = None
    cardinality: str | None = None


@dataclass(frozen=True)
class AllOf:
    """Filters joined by AND; for programs, as documents have no nesting."""

    parts: tuple[Any, ...]


@dataclass(frozen=True)
class AnyOf:
    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class Return:
    field: str
    aggregate: str | None = None
    date_part: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class GroupKey:
    field: str
    date_part: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Sort:
    field: str
    order: str = "asc"


@dataclass(frozen=True)
class Query:
    start: NodePattern
    traversals: tuple[Hop, ...] = ()
    filters: tuple[Filter, ...] = ()
    returns: tuple[Return, ...] = ()
    group_by: tuple[GroupKey, ...] = ()
    sort: tuple[Sort, ...] = ()
    limit: int | None = None
    distinct: bool = False
    prefix_label: str | None = None
    prefix_index: str | None = None
    #: A tree of AllOf, AnyOf, Not and plain Filters beside `filters`; set by programs only.
    where: Any = None

    def node_aliases(self) -> dict[str, str]:
        return {self.start.alias: self.start.label} | {h.target.alias: h.target.label for h in self.traversals}

    def describe(self) -> str:
        """The query in words, for traces."""
        parts = [f"from {_node(self.start)}"]
        for h in self.traversals:
            arrow = {"out": "->", "in": "<-", "both": "--"}[h.direction]
            depth = f" x{h.depth[0]}..{h.depth[1]}" if h.depth else ""
            parts.append(f"{'optionally ' if h.optional else ''}{h.source} {arrow}[{h.edge_label or 'any'}{depth}] {_node(h.target)}")
        if self.filters:
            parts.append("where " + " and ".join(f"{f.field} {f.op.replace('_', ' ')} {_value(f.value)}" for f in self.filters))
        if self.returns:
            parts.append("return " + ", ".join(_returned(r) for r in self.returns))
        if self.group_by:
            parts.append("grouped by " + ", ".join(f"{g.date_part}({g.field})" if g.date_part else g.field for g in self.group_by))
        if self.sort:
            parts.append("sorted by " + ", ".join(f"{s.field} {s.order}" for s in self.sort))
        if self.limit is not None:
            parts.append(f"at most {self.limit}")
        return "; ".join(parts) + ("; distinct" if self.distinct else "")


def _node(n: NodePattern) -> str:
    return f"{n.label or 'any node'} {n.alias}"


def _value(v: Any) -> str:
    if isinstance(v, str):
        return f'"{v}"'
    if isinstance(v, list):
        return "(" + ", ".join(_value(x) for x in v) + ")"
    return json.dumps(v)


def _returned(r: Return) -> str:
    inner = f"{r.aggregate}({r.field})" if r.aggregate else f"{r.date_part}({r.field})" if r.date_part else r.field
    return f"{inner} as {r.alias}" if r.alias else inner


@dataclass(frozen=True)
class TraversalQuery:
    """A retrieval of text chunks by a goal and named entities."""

    entities: tuple[str, ...] = ()
    goal: str = ""
    query: str = ""
    prefix_label: str | None = None
    prefix_index: str | None = None
    limit: int | None = None
    entity_types: tuple[str, ...] | None = None
    rerank: bool = False

    def search_texts(self) -> list[str]:
        """What is embedded: the goal, or the query without one, and each entity once."""
        goal = self.goal.strip() or self.query.strip()
        texts = [goal] if goal else []
        for e in self.entities:
            if e.strip() and e.strip() not in texts:
                texts.append(e.strip())
        return texts


@dataclass(frozen=True)
class EntityTypeQuery:
    """A search for the entity types that a text is about."""

    text: str
    top_k: int = 32
    score_threshold: float = 0.5
    include_neighbors: bool = False
    include_catalog_signal: bool = True
    catalog_threshold: float = 0.45
    fields: tuple[str, ...] | None = None
    collections: tuple[str, ...] | None = None


# --- parsing -----------------------------------------------------------------


def _need(d: Mapping, key: str, what: str) -> Any:
    if not isinstance(d, Mapping) or key not in d:
        raise QueryError(f"{what} needs {key!r}")
    return d[key]


def _str(v: Any, what: str) -> str:
    if not isinstance(v, str):
        raise QueryError(f"{what} must be a string")
    return v


def _list(d: Mapping, key: str) -> list:
    v = d.get(key)
    if v is None:
        return []
    if not isinstance(v, list):
        raise QueryError(f"{key!r} must be a list")
    return v


def _pattern(d: Any, what: str) -> NodePattern:
    return NodePattern(_str(_need(d, "alias", what), "alias"), _str(d.get("label") or "", "label"))


def _hop(d: Any, start: str) -> Hop:
    edge = _need(d, "edge", "traversal")
    depth = d.get("depth")
    pair = None
    if depth is not None:
        pair = (_need(depth, "min", "depth"), _need(depth, "max", "depth"))
        if not all(isinstance(x, int) and not isinstance(x, bool) for x in pair):
            raise QueryError("depth bounds must be integers")
    direction = edge.get("direction", "out")
    if direction not in DIRECTIONS:
        raise QueryError(f"unknown direction {direction!r}")
    return Hop(
        d.get("from") or start, _str(edge.get("label") or "", "edge label"), edge.get("alias"), direction,
        _pattern(_need(d, "target", "traversal"), "target"), pair, bool(d.get("optional", False)),
    )


def _filter(d: Any) -> Filter:
    return Filter(_str(_need(d, "field", "filter"), "field"), _str(_need(d, "op", "filter"), "op"), d.get("value"), d.get("type"), d.get("cardinality"))


def _return(d: Any) -> Return:
    agg, part = d.get("aggregate"), d.get("date_part")
    if agg is not None and agg not in AGGREGATES:
        raise QueryError(f"unknown aggregate {agg!r}")
    if part is not None and part not in DATE_PARTS:
        raise QueryError(f"unknown date part {part!r}")
    return Return(_str(_need(d, "field", "return"), "field"), agg, part, d.get("alias"))


def _group(d: Any) -> GroupKey:
    if isinstance(d, str):
        return GroupKey(d)
    part = d.get("date_part")
    if part is not None and part not in DATE_PARTS:
        raise QueryError(f"unknown date part {part!r}")
    return GroupKey(_str(_need(d, "field", "group_by"), "field"), part, d.get("alias"))


def _sort(d: Any) -> Sort:
    order = d.get("order", "asc")
    if order not in ("asc", "desc"):
        raise QueryError(f"unknown sort order {order!r}")
    return Sort(_str(_need(d, "field", "sort"), "field"), order)


def parse(doc: str | Mapping) -> Query:
    """A validated query of a JSON text or of its parsed form."""
    if isinstance(doc, str):
        try:
            doc = json.loads(doc)
        except ValueError as e:
            raise QueryError(f"not JSON: {e}") from e
    if not isinstance(doc, Mapping):
        raise QueryError("a query is an object")
    start = _pattern(_need(doc, "start", "query"), "start")
    limit = doc.get("limit")
    if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool)):
        raise QueryError("limit must be an integer")
    q = Query(
        start,
        tuple(_hop(h, start.alias) for h in _list(doc, "traversals")),
        tuple(_filter(f) for f in _list(doc, "filters")),
        tuple(_return(r) for r in _list(doc, "return")),
        tuple(_group(g) for g in _list(doc, "group_by")),
        tuple(_sort(s) for s in _list(doc, "sort")),
        limit, bool(doc.get("distinct", False)), doc.get("prefix_label"), doc.get("prefix_index"),
    )
    q = dedupe_edge_aliases(q)
    validate(q)
    return q


def parse_file(path: str) -> Query:
    return parse(Path(path).read_text(encoding="utf-8"))


def parse_traversal(doc: str | Mapping) -> TraversalQuery:
    d = json.loads(doc) if isinstance(doc, str) else doc
    types = d.get("entity_types")
    return TraversalQuery(
        tuple(d.get("entities") or ()), d.get("goal") or "", d.get("query") or "", d.get("prefix_label"), d.get("prefix_index"),
        d.get("limit"), tuple(types) if types is not None else None, bool(d.get("rerank", False)),
    )


def dedupe_edge_aliases(q: Query) -> Query:
    """Edge aliases that are taken get _2, _3 and so on; node aliases keep their names."""
    taken = {q.start.alias} | {h.target.alias for h in q.traversals}
    hops = []
    for h in q.traversals:
        name = h.edge_alias
        if name is not None:
            n = 2
            while name in taken:
                name, n = f"{h.edge_alias}_{n}", n + 1
            taken.add(name)
        hops.append(replace(h, edge_alias=name))
    return replace(q, traversals=tuple(hops))


def _ident(s: Any, what: str) -> None:
    if not isinstance(s, str) or not IDENT.match(s):
        raise QueryError(f"{what}: {s!r} is no identifier")


def _field_ref(s: str) -> None:
    parts = s.split(".")
    if len(parts) not in (1, 2):
        raise QueryError(f"{s!r} is no field reference")
    for p in parts:
        _ident(p, "field reference")


def validate(q: Query) -> None:
    """Raises QueryError on the first fault that needs no knowledge of the graph."""
    seen: set[str] = set()

    def node(n: NodePattern) -> None:
        _ident(n.alias, "alias")
        if n.label:
            _ident(n.label, "label")
        if n.alias in seen:
            raise QueryError(f"alias {n.alias!r} is bound twice")
        seen.add(n.alias)

    node(q.start)
    for h in q.traversals:
        _ident(h.source, "from")
        node(h.target)
        if h.edge_alias is not None:
            _ident(h.edge_alias, "edge alias")
        for rel in h.rels:
            _ident(rel, "edge label")
        if h.edge_label and len(h.rels) != len([r for r in h.rels if r]):
            raise QueryError(f"empty part in edge label {h.edge_label!r}")
        if h.depth is not None and not 1 <= h.depth[0] <= h.depth[1]:
            raise QueryError(f"depth {h.depth} is not 1 <= min <= max")
    for f in q.filters:
        _field_ref(f.field)
        if not OP_NAME.match(f.op):
            raise QueryError(f"malformed operator {f.op!r}")
    if not q.returns:
        raise QueryError("nothing is returned")
    for r in q.returns:
        _field_ref(r.field)
        if r.alias is not None:
            _ident(r.alias, "alias")
    for g in q.group_by:
        _field_ref(g.field)
        if g.alias is not None:
            _ident(g.alias, "alias")
    for s in q.sort:
        _field_ref(s.field)
    if q.limit is not None and q.limit < 1:
        raise QueryError("limit must be at least 1")
    if q.prefix_label is not None:
        _ident(q.prefix_label, "prefix_label")


# --- rewrites ----------------------------------------------------------------


def with_filter_context(q: Query) -> Query:
    """Adds the fields of plain filters to what is returned, for aliases that are returned already.

    Aggregates, distinct queries and typed filters are left alone.
    """
    if q.distinct or any(r.aggregate for r in q.returns):
        return q
    shown = {r.field.split(".")[0] for r in q.returns}
    have = {r.field for r in q.returns}
    extra = []
    for f in q.filters:
        alias, _, prop = f.field.partition(".")
        if f.type is None and prop and alias in shown and f.field not in have and alias not in have and prop not in HIDDEN_PROPERTIES:
            have.add(f.field)
            extra.append(Return(f.field))
    return replace(q, returns=q.returns + tuple(extra))


def with_hidden_ids(q: Query) -> Query:
    """Adds a.id AS __id_a for every node alias of a query that finds rows."""
    if any(r.aggregate for r in q.returns):
        return q
    have = {r.alias for r in q.returns}
    extra = tuple(Return(f"{a}.id", alias=f"__id_{a}") for a in q.node_aliases() if f"__id_{a}" not in have)
    return replace(q, returns=q.returns + extra)


@dataclass(frozen=True)
class Settings:
    """Limits of the planner. max_limit None plans queries without a cap on rows."""

    max_depth: int = 6
    max_limit: int | None = 5000
    auto_sources: bool = True
    strict_optional_where: bool = False
    search_threshold: float = 0.8
    search_k: int = 40
    reranker_threshold: float = 0.5
    fetch_k: int = 20
    grounding: bool = False
    extra: dict = field(default_factory=dict)
