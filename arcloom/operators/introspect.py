"""The live schema: labels, properties with types and values, relations with their ends; and its ontology form."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import CHUNK, SOURCE, GraphCatalog
from ..sources.ontology import Domain, Ontology, PropertySpec, TypeSpec

ENUM_CAP = 40
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}\Z")
_DATETIME = re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
#: Names of properties that identify rather than classify.
_IDENTIFIER = re.compile(r"(?:^|_)(?:id|uuid|guid|key|token|hash|url|uri|email|phone|name|title|text|description)$|Id$|ID$", re.I)


@dataclass
class LiveProperty:
    name: str
    type: str
    values: list[str] = field(default_factory=list)


@dataclass
class NodeKind:
    label: str
    properties: list[LiveProperty] = field(default_factory=list)
    scopes: list[str] = field(default_factory=list)
    domain: str | None = None


@dataclass
class RelKind:
    name: str
    source: str
    target: str
    properties: list[LiveProperty] = field(default_factory=list)
    domain: str | None = None


@dataclass
class LiveSchema:
    nodes: list[NodeKind] = field(default_factory=list)
    relations: list[RelKind] = field(default_factory=list)

    def filtered(self, text: str) -> LiveSchema:
        """Labels that contain a text, and relations with an end among them."""
        keep = [n for n in self.nodes if text.lower() in n.label.lower()]
        names = {n.label for n in keep}
        return LiveSchema(keep, [r for r in self.relations if r.source in names or r.target in names])


def infer(samples: list[Any]) -> str:
    """String, Int, Float, Bool, Date, Datetime or List of values as JSON has them; nulls say nothing."""
    kinds = set()
    for v in samples:
        if v is None:
            continue
        if isinstance(v, bool):
            kinds.add("Bool")
        elif isinstance(v, int):
            kinds.add("Int")
        elif isinstance(v, float):
            kinds.add("Float")
        elif isinstance(v, (list, tuple)):
            kinds.add("List")
        elif isinstance(v, str):
            kinds.add("Datetime" if _DATETIME.match(v) else "Date" if _DATE.match(v) else "String")
        else:
            kinds.add("Other")
    if len(kinds) == 1 and "Other" not in kinds:
        return kinds.pop()
    return "Float" if kinds == {"Int", "Float"} else "String"


def _declared(kind: T.DataType) -> str | None:
    if isinstance(kind, T.BooleanType):
        return "Bool"
    if isinstance(kind, T.IntegralType):
        return "Int"
    if isinstance(kind, T.NumericType):
        return "Float"
    if isinstance(kind, T.DateType):
        return "Date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "Datetime"
    if isinstance(kind, T.ArrayType):
        return "List"
    return None


def _properties(df, names: list[str], cap: int) -> list[LiveProperty]:
    """Types from the schema, or of text from the form of all its values; values of text properties that have few."""
    names = [p for p in names if not p.startswith("_")]
    texts = [p for p in names if isinstance(df.schema[p].dataType, T.StringType)]
    wanted = [p for p in texts if not _IDENTIFIER.search(p)]
    few: dict[str, list[str]] = {}
    forms: dict[str, str] = {}
    if texts:
        # one pass: which forms there are, and about how many values
        aggs = []
        for i, p in enumerate(texts):
            c = F.col(f"`{p}`")
            form = F.when(F.rlike(c, F.lit("^" + _DATETIME.pattern)), "Datetime").when(F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")), "Date").when(c.isNotNull(), "String")
            aggs += [F.min(form).alias(f"low{i}"), F.max(form).alias(f"high{i}")]
            if p in wanted:
                aggs.append(F.approx_count_distinct(c).alias(f"n{i}"))
        seen = df.agg(*aggs).first()
        for i, p in enumerate(texts):
            forms[p] = seen[f"low{i}"] if seen[f"low{i}"] == seen[f"high{i}"] and seen[f"low{i}"] else "String"
        likely = [p for i, p in enumerate(texts) if p in wanted and 0 < seen[f"n{i}"] <= cap * 1.2]
        if likely:
            # text of many values was sorted out above, so these sets are small
            sets = df.agg(*[F.collect_set(F.lower(F.trim(F.col(f"`{p}`")))).alias(str(i)) for i, p in enumerate(likely)]).first()
            few = {p: sorted(v for v in sets[i] if v) for i, p in enumerate(likely) if len(sets[i]) <= cap}
    out = []
    for p in names:
        kind = _declared(df.schema[p].dataType)
        if kind is None:
            kind = forms.get(p, "String")
        out.append(LiveProperty(p, kind, few.get(p, [])))
    return out


def introspect(g: GraphCatalog, cap: int = ENUM_CAP) -> LiveSchema:
    """The schema of a catalog. Looks at all values of text properties, one pass a table and one more for those of few values."""
    nodes = []
    for label in g.labels():
        t = g.nodes[label]
        kind = NodeKind(label, _properties(t.df, t.props, cap))
        if t.labels:
            seen = t.df.select(F.explode(F.col(f"`{t.labels}`")).alias("l")).distinct().collect()
            kind.scopes = sorted(r["l"][6:] for r in seen if r["l"].startswith("scope_"))
        nodes.append(kind)
    rels = [RelKind(e.rel, e.source_label, e.target_label, _properties(e.df, e.properties, cap)) for e in g.edges]
    return LiveSchema(nodes, sorted(rels, key=lambda r: (r.name, r.source, r.target)))


_STORAGE = {"Int": "Number", "Float": "Number", "Bool": "Bool", "Date": "Datetime", "Datetime": "Datetime", "List": "List"}


def as_ontology(schema: LiveSchema, domain: str = "default") -> Ontology:
    """A live schema as an ontology, by domain; text with a list of values becomes a keyword."""
    out = Ontology()

    def specs(props: list[LiveProperty]) -> list[PropertySpec]:
        return [PropertySpec(p.name, _STORAGE.get(p.type, "Keyword" if p.values else "Text"), allowed_values=p.values) for p in props]

    for n in schema.nodes:
        if n.label not in (SOURCE, CHUNK):
            out.domains.setdefault(n.domain or domain, Domain()).entity_types.append(TypeSpec(n.label, "", specs(n.properties)))
    for r in schema.relations:
        d = out.domains.setdefault(domain, Domain())
        if d.relation(r.name) is None:
            d.relation_types.append(TypeSpec(r.name, "", specs(r.properties)))
    return out


def split(schema: LiveSchema) -> dict[str, LiveSchema]:
    """A schema by domain; kinds without a domain are in none. A relation without one is of the domain that both its ends share."""
    of = {n.label: n.domain for n in schema.nodes}
    out: dict[str, LiveSchema] = {}
    for n in schema.nodes:
        if n.domain is not None:
            out.setdefault(n.domain, LiveSchema()).nodes.append(n)
    for r in schema.relations:
        domain = r.domain or (of.get(r.source) if of.get(r.source) == of.get(r.target) else None)
        if domain is not None:
            out.setdefault(domain, LiveSchema()).relations.append(r)
    return dict(sorted(out.items()))


def project(schema: LiveSchema, domains: list[Domain]) -> LiveSchema:
    """Only what the domains declare; allowed values are joined with those found."""
    entities = {t.name: t for d in domains for t in d.entity_types}
    relations = {t.name: t for d in domains for t in d.relation_types}

    def keep(props: list[LiveProperty], spec: TypeSpec) -> list[LiveProperty]:
        out = []
        for p in props:
            s = spec.property(p.name)
            if s is not None:
                out.append(LiveProperty(p.name, p.type, sorted(set(p.values) | {v.strip().lower() for v in s.allowed_values})))
        return out

    nodes = [NodeKind(n.label, keep(n.properties, entities[n.label]), n.scopes, n.domain) if n.label in entities else n for n in schema.nodes if n.label in entities or n.label in (SOURCE, CHUNK)]
    names = {n.label for n in nodes}
    rels = [RelKind(r.name, r.source, r.target, keep(r.properties, relations[r.name]), r.domain) for r in schema.relations if r.name in relations and r.source in names and r.target in names]
    return LiveSchema(nodes, rels)


def narrow(schema: LiveSchema, question: str, embedder: Any, entity_min: float = 0.30, property_min: float = 0.28, most: int = 12, least: int = 3) -> LiveSchema:
    """The part of a schema that a question is about.

    Labels over a threshold, at most `most` and at least the `least` nearest,
    with those one relation away; of their properties the near ones, and all
    that have a list of values.
    """
    if not schema.nodes:
        return schema
    text = lambda n: f"{n.label}: " + ", ".join(p.name for p in n.properties)
    v = embedder.embed([question, *[text(n) for n in schema.nodes]])
    ranked = sorted(zip((v[1:] @ v[0]).tolist(), schema.nodes), key=lambda x: (-x[0], x[1].label))
    near = [n for s, n in ranked if s >= entity_min][:most]
    if len(near) < least:
        near = [n for _, n in ranked[:least]]
    names = {n.label for n in near}
    around = names | {x for r in schema.relations for x in (r.source, r.target) if r.source in names or r.target in names}
    nodes = []
    for n in schema.nodes:
        if n.label not in around:
            continue
        props = n.properties
        if props:
            w = embedder.embed([question, *[p.name.replace("_", " ") for p in props]])
            scores = (w[1:] @ w[0]).tolist()
            kept = [p for s, p in zip(scores, props) if s >= property_min or p.values]
            props = kept or props
        nodes.append(NodeKind(n.label, props, n.scopes, n.domain))
    return LiveSchema(nodes, [r for r in schema.relations if r.source in around and r.target in around])
