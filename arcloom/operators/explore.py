"""Read-only exploration of a graph catalog: cards, neighbours, overview, tables, search, subgraphs, timelines."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GraphError
from ..functions.scalars import iso_epoch
from ..plans import dsl
from ..plans.compile import Engine, union_all
from ..plans.language import Model, answer, question_to_query
from ..plans.text import TextPredicate
from ..sources.catalog import CHUNK, PROVENANCE, SOURCE, EdgeTable, NodeTable
from ..sources.ontology import Ontology
from .introspect import introspect

PAGE = 50
MAX_SOURCES = 200
MAX_NODES, MAX_EDGES = 100, 500
KEY_COLUMNS = 6


def bucket_of(ontology: Ontology | None, label: str, name: str, kind: T.DataType) -> str | None:
    """identifiers, descriptions, facts, dates or other; None for what is hidden."""
    if name.startswith("_"):
        return None
    spec = ontology.property(label, name) if ontology else None
    if spec:
        return {"Keyword": "identifiers", "List": "identifiers", "Text": "descriptions", "Number": "facts", "Bool": "facts", "Datetime": "dates"}[spec.type]
    return "facts" if isinstance(kind, (T.NumericType, T.BooleanType)) else "other"


def is_id(c: Column, kind: T.DataType, id: str | int) -> Column:
    """Whether a column of ids holds id, in either form: the literal takes the column's type, so the test reaches the scan."""
    if isinstance(kind, T.StringType):
        return c == F.lit(str(id))
    if isinstance(kind, T.IntegralType):
        text = str(id)
        same = re.fullmatch(r"-?(0|[1-9]\d*)", text) and text != "-0" and abs(int(text)) < 1 << 63
        return c == F.lit(int(text)).cast(kind) if same and _fits(int(text), kind) else F.lit(False)
    return c.cast("string") == F.lit(str(id))


def _fits(value: int, kind: T.DataType) -> bool:
    bits = {"tinyint": 7, "smallint": 15, "int": 31}.get(kind.simpleString(), 63)
    return -(1 << bits) <= value < 1 << bits


class Explorer:
    def __init__(self, engine: Engine, ontology: Ontology | None = None, model: Model | None = None, prefix_label: str | None = None, prefix_index: str | None = None):
        self.engine, self.g, self.ontology = engine, engine.catalog, ontology
        self.model, self.prefix_label, self.prefix_index = model, prefix_label, prefix_index

    # --- pieces --------------------------------------------------------------

    def _id(self, t: NodeTable):
        return F.col(f"`{'id' if 'id' in t.props else t.key}`").cast("string")

    def name_column(self, t: NodeTable):
        """name, else title, else the id."""
        names = [F.col(f"`{p}`").cast("string") for p in ("name", "title") if p in t.props]
        named = [p for p in t.props if p.endswith("_name")]
        return F.coalesce(*names, *[F.col(f"`{p}`").cast("string") for p in named[:1]], self._id(t))

    def _named(self, t: NodeTable, id: str | int) -> Column:
        """Whether a row of a node table has an id, its public or its stored one."""
        here = is_id(F.col(f"`{t.key}`"), t.df.schema[t.key].dataType, id)
        return here | is_id(F.col("`id`"), t.df.schema["id"].dataType, id) if "id" in t.props and t.key != "id" else here

    def _rows(self, t: NodeTable, where: Column | None = None) -> DataFrame:
        """nid, id, type, name, props as JSON."""
        shown = [F.col(f"`{p}`") for p in t.props if not p.startswith("_")]
        df = t.df if where is None else t.df.where(where)
        return df.select(
            F.col(f"`{t.key}`").cast("string").alias("nid"), self._id(t).alias("id"), F.lit(t.label).alias("type"), self.name_column(t).alias("name"), F.to_json(F.struct(*shown)).alias("props")
        )

    def _edge_ends(self, e: EdgeTable, at: str | None = None, id: str | int | None = None) -> DataFrame:
        """The ends of all edges, or of those whose end at (source or target) is id."""
        df = e.df
        if at is not None:
            end = getattr(e, at)
            df = df.where(is_id(F.col(f"`{end}`"), df.schema[end].dataType, id))
        return df.select(
            F.lit(e.rel).alias("rel"), F.lit(e.source_label).alias("src_type"), F.col(f"`{e.source}`").cast("string").alias("src"), F.lit(e.target_label).alias("dst_type"), F.col(f"`{e.target}`").cast("string").alias("dst")
        ).where("src is not null and dst is not null")

    def _tables(self, label: str | None) -> list[NodeTable]:
        return [self.g.nodes[label]] if label else [self.g.nodes[x] for x in self.g.labels()]

    # --- cards and neighbours ------------------------------------------------

    def entity(self, id: str | int, label: str | None = None) -> DataFrame:
        """The node of an id: id, type, name, confidence, props, sources, relations; the first by type if several have it.

        confidence is the property of that name, if it is a number; it is never computed.
        Relations are counts by type, direction and the other end's type,
        provenance left out.
        """
        # the public id first, then the stored one
        found = union_all([self._rows(t, self._named(t, id)) for t in self._tables(label)]).orderBy((F.col("id") == str(id)).desc(), "type", "nid").limit(1).collect()
        kinds = "nid string, id string, type string, name string, props string"
        node = self.g.spark.createDataFrame(found, kinds)
        nid, type_ = (found[0]["nid"], found[0]["type"]) if found else ("", "")
        rels = self.relation_summary(nid, type_)
        listed = rels.agg(F.array_sort(F.collect_list(F.struct("rel", "direction", "other_type", "count"))).alias("relations"))
        ways = [self._edge_ends(e, "source", nid) for e in self.g.find_edges(PROVENANCE, {type_}, {SOURCE})]
        if ways:
            sources = union_all(ways).agg(F.array_sort(F.collect_set("dst")).alias("sources"))
        else:
            sources = self.g.spark.range(1).select(F.array().cast("array<string>").alias("sources"))
        # one row each
        return node.join(listed, how="cross").join(sources, how="cross").select(
            "id", "type", "name", F.get_json_object("props", "$.confidence").try_cast("double").alias("confidence"), "props", "sources", "relations"
        )

    def relation_summary(self, id: str | int | None = None, label: str | None = None, among: DataFrame | None = None) -> DataFrame:
        """(node_type, node, rel, direction, other_type, count) of one node, of few (type, nid), or of all."""
        frames = []
        for e in self.g.edges:
            if e.rel in PROVENANCE:
                continue
            for end, mine, other, here, way in (("source", "src", "dst", e.source_label, "out"), ("target", "dst", "src", e.target_label, "in")):
                if label in (None, here):
                    ends = self._edge_ends(e) if id is None else self._edge_ends(e, end, id)
                    frames.append(ends.select(F.col(f"{mine}_type").alias("node_type"), F.col(mine).alias("node"), "rel", F.lit(way).alias("direction"), F.col(f"{other}_type").alias("other_type")))
        if not frames:
            return self.g.spark.createDataFrame([], "node_type string, node string, rel string, direction string, other_type string, count long")
        both = union_all(frames)
        if among is not None:
            few = among.select(F.col("type").alias("node_type"), F.col("nid").alias("node"))
            both = both.join(few, ["node_type", "node"], "left_semi")
        return both.groupBy("node_type", "node", "rel", "direction", "other_type").agg(F.count("*").alias("count"))

    def neighbors(self, id: str | int, label: str, rels: list[str] | None = None, target: str | None = None, direction: str | None = None, limit: int | None = PAGE, offset: int = 0) -> DataFrame:
        """(rel, direction, type, id, name, props) one edge away, by rel and id; one row more than limit tells that there are more."""
        frames = []
        for e in self.g.find_edges(rels or [], None, None):
            for way, here, there, mine, other in (("out", e.source_label, e.target_label, "source", "dst"), ("in", e.target_label, e.source_label, "target", "src")):
                if here != label or direction not in (None, way) or target not in (None, there) or there not in self.g.nodes:
                    continue
                ids = self._edge_ends(e, mine, id).select("rel", F.lit(way).alias("direction"), F.col(other).alias("nid"))
                frames.append(ids.join(self._rows(self.g.nodes[there]), "nid").select("rel", "direction", "type", "id", "name", "props"))
        if not frames:
            return self.g.spark.createDataFrame([], "rel string, direction string, type string, id string, name string, props string")
        out = union_all(frames).orderBy("rel", "id", "direction")
        return out if limit is None else out.offset(offset).limit(limit)

    # --- overview and tables -------------------------------------------------

    def overview(self) -> DataFrame:
        """(kind, name, count): node types without sources and chunks, relations without provenance, and totals."""
        # all that lies in one table is counted in one pass over it
        passes: list[tuple[DataFrame, list[tuple[str, str, Column]]]] = []

        def add(df: DataFrame, kind: str, name: str, condition: Column) -> None:
            mine = next((p for p in passes if p[0].sameSemantics(df)), None)
            if mine is None:
                mine = (df, [])
                passes.append(mine)
            mine[1].append((kind, name, condition))

        for x, t in sorted(self.g.nodes.items()):
            if x not in (SOURCE, CHUNK):
                add(t.df, "type", t.label, F.lit(True))
        for e in self.g.edges:
            if e.rel not in PROVENANCE:
                add(e.df, "relation", e.rel, F.col(f"`{e.source}`").isNotNull() & F.col(f"`{e.target}`").isNotNull())
        frames = []
        for df, counted in passes:
            row = df.agg(*[F.count(F.when(c, 1)).alias(f"n{i}") for i, (_, _, c) in enumerate(counted)])
            frames.append(row.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.col(f"n{i}").alias("count")) for i, (kind, name, _) in enumerate(counted)])).alias("r")).select("r.*"))
        both = union_all(frames).groupBy("kind", "name").agg(F.sum("count").alias("count"))
        totals = both.groupBy(F.lit("total").alias("kind"), F.col("kind").alias("name")).agg(F.sum("count").alias("count"))
        return both.unionByName(totals)

    def sources(self) -> DataFrame:
        t = self.g.nodes[SOURCE]
        return t.df.select(self.name_column(t).alias("name")).orderBy("name").limit(MAX_SOURCES)

    def key_columns(self, label: str) -> list[str]:
        t = self.g.nodes[label]
        shown = [p for p in t.props if not p.startswith("_") and p != t.key and isinstance(t.df.schema[p].dataType, (T.AtomicType,))]
        return shown[:KEY_COLUMNS]

    def entities_of_type(self, label: str, limit: int = PAGE, offset: int = 0, sort: str | None = None, order: str = "asc") -> tuple[DataFrame, int]:
        """A page of a type's nodes, by name unless told otherwise, and how many there are."""
        t = self.g.nodes[label]
        key = F.col(f"`{sort}`") if sort else F.col("name")
        page = t.df.select(self._id(t).alias("id"), self.name_column(t).alias("name"), *[F.col(f"`{p}`") for p in self.key_columns(label) if p not in ("id", "name")])
        key = key.asc_nulls_last() if order == "asc" else key.desc_nulls_last()
        return page.orderBy(key, "id").offset(offset).limit(limit), t.df.count()

    # --- search --------------------------------------------------------------

    def search(self, text: str, label: str | None = None, mode: str = "auto", exact: bool = False, limit: int | None = PAGE) -> DataFrame:
        """(type, id, name, score): by meaning where a type has a text index, by words otherwise, or as told.

        Auto falls back to words if meaning finds nothing. Words are looked for
        in every text property, chunks are left out unless asked for.
        """
        if mode in ("semantic", "auto"):
            found = self._semantic(text, label, limit or PAGE)
            if found is not None and (mode == "semantic" or not found.isEmpty()):
                return found
            if mode == "semantic":
                return self.g.spark.createDataFrame([], "type string, id string, name string, score double")
        out = self.keyword(text, label, exact)
        return out if limit is None else out.limit(limit)

    def keyword(self, text: str, label: str | None = None, exact: bool = False) -> DataFrame:
        frames = []
        wanted = F.lit(text.strip().lower())
        for t in self._tables(label):
            if label is None and t.label == CHUNK:
                continue
            props = [p for p in t.props if isinstance(t.df.schema[p].dataType, T.StringType) and not p.startswith("_")]
            if not props:
                continue
            cols = [F.col(f"`{p}`") for p in props]
            hit = reduce(lambda a, b: a | b, [F.coalesce((c == text) if exact else F.contains(F.lower(F.trim(c)), wanted), F.lit(False)) for c in cols])
            frames.append(t.df.where(hit).select(F.lit(t.label).alias("type"), self._id(t).alias("id"), self.name_column(t).alias("name"), F.lit(None).cast("double").alias("score")))
        if not frames:
            return self.g.spark.createDataFrame([], "type string, id string, name string, score double")
        return union_all(frames).orderBy("type", "id")

    def _semantic(self, text: str, label: str | None, limit: int) -> DataFrame | None:
        indexes = {x: i for x, i in self.engine.indexes.items() if label in (None, x)}
        if not indexes:
            return None
        frames = []
        for x, index in indexes.items():
            t = self.g.nodes[x]
            hits = index.retrieve(TextPredicate(x, text, False, False, False), replace(self.engine.settings, grounding=True, fetch_k=limit))
            hits = hits.groupBy(F.col("nid").cast("string").alias("__n")).agg(F.max("score").alias("score"))
            frames.append(t.df.join(hits, F.col(f"`{t.key}`").cast("string") == F.col("__n")).select(F.lit(x).alias("type"), self._id(t).alias("id"), self.name_column(t).alias("name"), "score"))
        return union_all(frames).orderBy(F.desc("score"), "type", "id").limit(limit)

    # --- subgraphs and timelines ---------------------------------------------

    def edges_among(self, nodes: DataFrame) -> DataFrame:
        """(rel, src_type, src, dst_type, dst) with both ends in nodes (type, nid)."""
        ids = nodes.select(F.col("type").alias("__t"), F.col("nid").cast("string").alias("__n")).distinct()
        ends = union_all([self._edge_ends(e) for e in self.g.edges])
        a = ends.join(ids, (F.col("src_type") == F.col("__t")) & (F.col("src") == F.col("__n")), "left_semi")
        return a.join(ids, (F.col("dst_type") == F.col("__t")) & (F.col("dst") == F.col("__n")), "left_semi")

    def subgraph(self, nodes: DataFrame, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
        """Rows of some nodes (type, nid), and the edges among them, both capped."""
        few = nodes.select("type", F.col("nid").cast("string").alias("nid")).distinct().orderBy("type", "nid").limit(max_nodes)
        rows = union_all([self._rows(self.g.nodes[x]) for x in self.g.labels()]).join(few, ["type", "nid"], "left_semi")
        edges = self.edges_among(few).orderBy("rel", "src", "dst").limit(max_edges)
        return rows, edges

    def subgraph_of_type(self, label: str, limit: int = PAGE) -> tuple[DataFrame, DataFrame]:
        t = self.g.nodes[label]
        page = self._rows(t).orderBy(F.asc_nulls_last("name"), "nid").limit(limit).select("type", "nid")
        return self.subgraph(page)

    def timeline(self, label: str, limit: int | None = None) -> DataFrame:
        """(epoch, date, property, id, name, type): an event for every dated property, undated texts last."""
        t = self.g.nodes[label]
        frames = []
        for p in t.props:
            kind = t.df.schema[p].dataType
            bucket = bucket_of(self.ontology, label, p, kind)
            c = F.col(f"`{p}`")
            base = [F.lit(p).alias("property"), self._id(t).alias("id"), self.name_column(t).alias("name"), F.lit(label).alias("type")]
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                epoch = F.unix_timestamp(c.cast("timestamp"))
                frames.append(t.df.where(c.isNotNull()).select(epoch.alias("epoch"), F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), *base))
            elif bucket == "dates" and isinstance(kind, T.IntegralType):
                frames.append(t.df.where(c.isNotNull()).select(c.cast("long").alias("epoch"), F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), *base))
            elif isinstance(kind, T.StringType) and bucket in ("dates", "other"):
                shaped = F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}"))
                rows = t.df.where(c.isNotNull() if bucket == "dates" else shaped)
                events = rows.select(F.when(shaped, iso_epoch(c)).alias("epoch"), c.alias("date"), *base)
                frames.append(events if bucket == "dates" else events.where("epoch is not null"))
        if not frames:
            return self.g.spark.createDataFrame([], "epoch long, date string, property string, id string, name string, type string")
        out = union_all(frames).orderBy(F.asc_nulls_last("epoch"), "date", "id", "property")
        return out if limit is None else out.limit(limit)

    # --- queries -------------------------------------------------------------

    def ask(self, question: str, cap: int | None = PAGE, answered: bool = True) -> dict[str, Any]:
        """A question through the model: what `run_query` gives, with the query, the sources behind the rows and, if wanted, an answer in a sentence."""
        if self.model is None:
            raise GraphError("questions need a model")
        schema = introspect(self.g)
        got = question_to_query(question, schema, self.model, self.engine.plan, prefix_label=self.prefix_label, prefix_index=self.prefix_index, types=self.engine.types, registry=self.engine.registry)
        out = self.run_query(got.query, cap)
        rows = out["table"].collect()  # at most cap
        out |= {"query": got.query, "attempts": got.attempts, "rows": rows, "answer": answer(question, [r.asDict() for r in rows], self.model) if answered else None}
        return out

    def run_query(self, doc: str | Mapping[str, Any] | dsl.Query, cap: int | None = None) -> dict[str, Any]:
        """Runs a document as the explorer shows it: the visible table, the nodes behind it, and a trace."""
        q = doc if isinstance(doc, dsl.Query) else dsl.parse(doc)
        if self.prefix_label or self.prefix_index:  # the tenant's, whatever the document says
            q = replace(q, prefix_label=self.prefix_label, prefix_index=self.prefix_index)
        shown = dsl.with_filter_context(q)
        full = dsl.with_hidden_ids(shown) if not q.distinct else shown
        df = self.engine.plan(full)
        hidden = [c for c in df.columns if c.startswith("__id_") or c in ("score", "sources") and c not in {r.alias for r in q.returns}]
        table = df.drop(*hidden)
        if q.distinct:
            table = table.distinct()
        if cap is not None:
            table = table.limit(cap)
        labels = q.node_aliases()
        ids = [c for c in hidden if c.startswith("__id_")]
        nodes = union_all([df.select(F.lit(labels[c[5:]]).alias("type"), F.col(c).cast("string").alias("nid")).where("nid is not null") for c in ids]).distinct() if ids else None
        owner = {}
        for r in shown.returns:
            owner[r.alias or r.field] = r.field.partition(".")[0]
        sources = df.select(F.explode("sources").alias("name")).distinct().orderBy("name") if "sources" in df.columns else None
        return {"table": table, "nodes": nodes, "owners": owner, "sources": sources, "trace": [q.describe(), full.describe()]}
