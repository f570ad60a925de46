"""A stored graph: idempotent upserts, deletion by source, export, and its catalog.

The store is a folder of immutable snapshots; a write makes a new one and then
moves a pointer, so readers and retried tasks see one state or the other.
Properties are a map from name to JSON text.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import IngestError
from ..sources.catalog import CHUNK, PROVENANCE, SOURCE, GraphCatalog
from ..sources.graph_json import CANONICAL, Graph, to_frames
from ..sources.vectors import VectorStore, collection

NODE_SCHEMA = "nid long, type string, key_field string, key string, labels array<string>, props map<string,string>"
EDGE_SCHEMA = "eid long, rel string, src long, dst long, props map<string,string>"


def overlay(old: Column, new: Column) -> Column:
    """Map of old entries, with those of new over them."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def scope_label(scope: Column) -> Column:
    return F.concat(F.lit("scope_"), scope)


#: Rows from which an id is joined by a broadcast; fewer rows of one id fit any task.
HOT = 20_000


def at_ends(rows: DataFrame, ends: DataFrame, name: str, nid: str) -> DataFrame:
    """rows with the node of an end in place of its local id; rows without one are left out.

    A join by id would hold all rows of an id in one task. Ids of HOT rows or more,
    stored or not, are few, at most a HOT-th of the rows: they are joined where
    their rows are.
    """
    hot = rows.groupBy(F.col(name).alias("__id")).count().where(F.col("count") >= HOT).select("__id")
    there = F.col(name) == F.col("__id")
    cold = rows.join(F.broadcast(hot), there, "left_anti").join(ends.toDF(name, nid), name).drop(name)
    known = ends.join(F.broadcast(hot), F.col("local_id") == F.col("__id"), "left_semi")
    return cold.unionByName(rows.join(F.broadcast(known.toDF("__id", nid)), there).drop("__id", name))


@dataclass
class IngestSummary:
    nodes: int = 0
    edges: int = 0
    new_nodes: int = 0
    new_edges: int = 0
    elapsed_ms: int = 0
    merges: dict = field(default_factory=dict)


def doomed(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(nid, why) of a source, its chunks, and the entities that no other source mentions."""
    sources = nodes.where((F.col("type") == SOURCE) & (F.col("props")["name"] == json.dumps(name, ensure_ascii=False))).select("nid")
    traced = edges.where(F.col("rel").isin(*PROVENANCE)).select("rel", "src", "dst")
    mine = F.col("s").isNotNull()
    by_node = traced.join(sources.select(F.col("nid").alias("s")), traced["dst"] == F.col("s"), "left").groupBy("src").agg(
        F.max(mine.cast("int")).alias("any"), F.min(mine.cast("int")).alias("all")
    )
    hit = by_node.join(nodes.select("nid", "type"), by_node["src"] == F.col("nid")).where((F.col("any") == 1) & ((F.col("all") == 1) | (F.col("type") == CHUNK)))
    return sources.select("nid", F.lit("source").alias("why")).union(hit.select("nid", F.when(F.col("type") == CHUNK, "chunk").otherwise("entity")))


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, prefix_label: str | None = None, vectors: VectorStore | None = None, text_fields: Mapping[str, Sequence[str]] | None = None, prefix_index: str | None = None):
        """vectors: where the texts of ingested nodes are embedded and indexed, under prefix_index; text_fields: a type's text properties, beside its canonical text and the text of chunks."""
        self.spark, self.path, self.prefix = spark, path.rstrip("/"), prefix_label
        self.vectors, self.text_fields, self.prefix_index = vectors, dict(text_fields or {}), prefix_index
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- snapshots -----------------------------------------------------------

    def version(self) -> int:
        """The last snapshot that is complete; 0 without one. The pointer is a file named by the version."""
        done = self._path(f"{self.path}/committed")
        if not self._fs.exists(done):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(done)), default=0)

    def _begin(self) -> tuple[int, int]:
        """(version that a write starts from, number that it alone may write to)."""
        base = v = self.version()
        self._fs.mkdirs(self._path(f"{self.path}/claimed"))
        while not self._fs.createNewFile(self._path(f"{self.path}/claimed/{v + 1}")):
            v += 1
        return base, v + 1

    def _commit(self, base: int, version: int) -> None:
        """Puts a version in force, unless another writer has done so since base."""
        if self.version() != base:
            raise IngestError(f"the graph was changed by another writer after version {base}; ingest again")
        self._fs.mkdirs(self._path(f"{self.path}/committed"))
        self._fs.createNewFile(self._path(f"{self.path}/committed/{version}"))

    def nodes(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(NODE_SCHEMA).parquet(f"{self.path}/v{v}/nodes") if v else self.spark.createDataFrame([], NODE_SCHEMA)

    def edges(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(EDGE_SCHEMA).parquet(f"{self.path}/v{v}/edges") if v else self.spark.createDataFrame([], EDGE_SCHEMA)

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the last snapshots."""
        for v in range(1, self.version() - keep + 1):
            self._fs.delete(self._path(f"{self.path}/v{v}"), True)

    def _write(self, nodes: DataFrame | None, edges: DataFrame | None) -> int:
        base, v = self._begin()
        (nodes if nodes is not None else self.nodes()).write.mode("overwrite").parquet(f"{self.path}/v{v}/nodes")
        (edges if edges is not None else self.edges()).write.mode("overwrite").parquet(f"{self.path}/v{v}/edges")
        self._commit(base, v)
        return v

    # --- upsert --------------------------------------------------------------

    def ingest(self, graph: Graph | tuple[DataFrame, DataFrame], resolver: Any = None) -> IngestSummary:
        """Merges entities by (type, key) and relations by (type, ends); later rows win property by property.

        A relation whose end is not stored makes no edge. A resolver may first
        give soft entities the keys of nodes that they are the same as.
        """
        began = time.time()
        entities, relations = to_frames(self.spark, graph) if isinstance(graph, Graph) else graph
        report: dict = {}
        if resolver is not None:
            entities, report = resolver.resolve(entities, self)
        before = self.nodes()
        merged = self.merge_nodes(before, entities)
        base, v = self._begin()
        merged.write.mode("overwrite").parquet(f"{self.path}/v{v}/nodes")
        nodes = self.spark.read.schema(NODE_SCHEMA).parquet(f"{self.path}/v{v}/nodes")
        old_edges = self.edges()
        edges = self.merge_edges(old_edges, nodes, entities, relations)
        edges.write.mode("overwrite").parquet(f"{self.path}/v{v}/edges")
        edges = self.spark.read.schema(EDGE_SCHEMA).parquet(f"{self.path}/v{v}/edges")
        if self.vectors is not None:
            self.embed(nodes.join(entities.select("type", "key_field", "key").distinct(), ["type", "key_field", "key"], "left_semi"))
        counts = (before.count(), old_edges.count())
        self._commit(base, v)
        n, m = nodes.count(), edges.count()
        return IngestSummary(n, m, n - counts[0], m - counts[1], int((time.time() - began) * 1000), report)

    def embed(self, nodes: DataFrame) -> None:
        """Puts the texts of nodes into their collections; texts that are there already are not embedded again."""
        fields = {CANONICAL: None, "text": [CHUNK]}
        for type_, names in self.text_fields.items():
            for name in names:
                fields[name] = sorted({*(fields.get(name) or []), type_})
        for name, types in fields.items():
            value = json_text(F.col("props")[name])
            mine = nodes.where(F.col("type") != CHUNK) if types is None else nodes.where(F.col("type").isin(types))
            rows = mine.select("nid", F.col("type").alias("label"), value.alias("text")).where("text is not null and text <> ''")
            if not rows.isEmpty():
                self.vectors.upsert(collection(name, "", self.prefix_index), rows)

    def merge_nodes(self, old: DataFrame, entities: DataFrame) -> DataFrame:
        """old nodes with entities over them: one row per (type, key field, key), ids of old rows kept."""
        order = Window.partitionBy("type", "key_field", "key").orderBy("idx")
        labels = F.array_distinct(
            F.concat(
                F.array("type"), F.when(F.col("domain").isNotNull(), F.array("domain")).otherwise(F.array().cast("array<string>")),
                F.transform("scopes", scope_label), F.array(F.lit(self.prefix)) if self.prefix else F.array().cast("array<string>"),
            )
        )
        rows = entities.where("props is not null").withColumns({"labels": labels, "n": F.row_number().over(order)})
        # entries of all rows of one key; the last one of a name wins
        entries = rows.select("type", "key_field", "key", "n", F.explode("props").alias("name", "value"))
        last = entries.groupBy("type", "key_field", "key", "name").agg(F.max_by("value", "n").alias("value"))
        props = last.groupBy("type", "key_field", "key").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("new_props"))
        new = rows.groupBy("type", "key_field", "key").agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("new_labels")).join(props, ["type", "key_field", "key"])
        both = old.join(new, ["type", "key_field", "key"], "full_outer")
        top = old.agg(F.coalesce(F.max("nid"), F.lit(0)).alias("m")).first()["m"]
        # unique, as it is written once before anything reads it
        fresh = F.monotonically_increasing_id() + F.lit(top + 1)
        none = F.array().cast("array<string>")
        return both.select(
            F.coalesce("nid", fresh).alias("nid"), "type", "key_field", "key",
            F.array_union(F.coalesce("labels", none), F.coalesce("new_labels", none)).alias("labels"), overlay(F.col("props"), F.col("new_props")).alias("props"),
        )

    def merge_edges(self, old: DataFrame, nodes: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
        """old edges with relations over them: one row per (rel, src, dst); relations without both ends stored are left out."""
        ends = entities.join(nodes.select("nid", "type", "key_field", "key"), ["type", "key_field", "key"]).select("local_id", "nid")
        found = at_ends(at_ends(relations.select("idx", "rel", "from_id", "to_id", "props"), ends, "from_id", "src"), ends, "to_id", "dst")
        entries = found.select("rel", "src", "dst", "idx", F.explode_outer("props").alias("name", "value"))
        last = entries.groupBy("rel", "src", "dst", "name").agg(F.max_by("value", "idx").alias("value"))
        new = last.groupBy("rel", "src", "dst").agg(
            F.map_from_entries(F.filter(F.collect_list(F.struct("name", "value")), lambda x: x["name"].isNotNull())).alias("new_props")
        )
        both = old.join(new, ["rel", "src", "dst"], "full_outer")
        top = old.agg(F.coalesce(F.max("eid"), F.lit(0)).alias("m")).first()["m"]
        return both.select(
            F.coalesce("eid", F.monotonically_increasing_id() + F.lit(top + 1)).alias("eid"), "rel", "src", "dst", overlay(F.col("props"), F.col("new_props")).alias("props")
        )

    # --- deletion ------------------------------------------------------------

    def doomed(self, name: str) -> DataFrame:
        return doomed(self.nodes(), self.edges(), name)

    def delete_by_source(self, name: str, vectors: DataFrame | None = None) -> tuple[dict[str, int], DataFrame | None]:
        """Removes what only this source brought, with all edges at it; counts by reason, and the vectors that are left."""
        gone = self.doomed(name)
        counts = {r["why"]: r["count"] for r in gone.groupBy("why").count().collect()}
        if not counts:
            return {}, vectors
        ids = gone.select("nid").distinct()
        left_vectors = vectors.join(ids, "nid", "left_anti") if vectors is not None else None
        if self.vectors is not None:
            self.vectors.sweep(ids)
        edges = self.edges().join(ids.select(F.col("nid").alias("src")), "src", "left_anti").join(ids.select(F.col("nid").alias("dst")), "dst", "left_anti")
        self._write(self.nodes().join(ids, "nid", "left_anti"), edges.select("eid", "rel", "src", "dst", "props"))
        return counts, left_vectors

    # --- reading -------------------------------------------------------------

    def property_schemas(self) -> dict[str, dict[str, str]]:
        """Type of each node type's properties, by one pass over the stored JSON."""
        each = self.nodes().select("type", F.explode("props").alias("name", "value"))
        kinds = each.groupBy("type", "name").agg(F.collect_set(json_kind(F.col("value"))).alias("kinds"))
        out: dict[str, dict[str, str]] = {}
        for r in kinds.collect():  # one row per type and property
            out.setdefault(r["type"], {})[r["name"]] = merge_kinds(set(r["kinds"]))
        return {t: out[t] for t in sorted(out)}

    def catalog(self) -> GraphCatalog:
        """The stored graph for the compiler: one node table per type, one edge table per type and ends."""
        g = GraphCatalog(self.spark)
        nodes, edges = self.nodes(), self.edges()
        for t, props in self.property_schemas().items():
            cols = [from_json_text(F.col("props")[p], kind).alias(p) for p, kind in sorted(props.items()) if p not in ("nid", "labels")]
            g.add_node(t, nodes.where(F.col("type") == t).select("nid", "labels", *cols), "nid", labels="labels")
        ends = (
            edges.join(nodes.select(F.col("nid").alias("src"), F.col("type").alias("a")), "src").join(nodes.select(F.col("nid").alias("dst"), F.col("type").alias("b")), "dst")
        )
        kinds = ends.select("rel", "a", "b", F.explode_outer("props").alias("name", "value")).groupBy("rel", "a", "b", "name").agg(F.collect_set(json_kind(F.col("value"))).alias("kinds"))
        seen: dict[tuple[str, str, str], dict[str, str]] = {}
        for r in kinds.collect():
            props = seen.setdefault((r["rel"], r["a"], r["b"]), {})
            if r["name"] is not None:
                props[r["name"]] = merge_kinds(set(r["kinds"]))
        for (rel, a, b), props in sorted(seen.items()):
            cols = [from_json_text(F.col("props")[p], kind).alias(p) for p, kind in sorted(props.items()) if p not in ("eid", "src", "dst", "rel", "tab")]
            df = ends.where((F.col("rel") == rel) & (F.col("a") == a) & (F.col("b") == b)).select("eid", "src", "dst", *cols)
            g.add_edge(rel, a, b, df, "src", "dst", key="eid", props=tuple(c for c in df.columns if c not in ("eid", "src", "dst")))
        return g

    def export(self, nids: DataFrame) -> dict:
        """A subgraph as a graph document that can be ingested again; edges with an end outside are left out."""
        nodes = self.nodes().join(nids.select("nid"), "nid", "left_semi").collect()
        inside = {r["nid"]: r for r in nodes}
        edges = self.edges().join(nids.select(F.col("nid").alias("src")), "src", "left_semi").join(nids.select(F.col("nid").alias("dst")), "dst", "left_semi").collect()
        entities = []
        for r in sorted(nodes, key=lambda r: r["nid"]):
            props = {k: json.loads(v) for k, v in r["props"].items() if not k.startswith("_")}
            key = {"soft": CANONICAL} if r["key_field"] == CANONICAL else {"strict": r["key_field"]}
            typed = {k: {"type": _kind_name(v, r["type"], k), "value": v} for k, v in props.items() if k != "id"}
            entities.append({"id": str(r["nid"]), "type": r["type"], "primary_key": key, "properties": typed | ({"id": {"type": "Keyword", "value": props["id"]}} if "id" in props else {})})
        relations = [
            {"from": str(e["src"]), "to": str(e["dst"]), "type": e["rel"], "properties": {k: json.loads(v) for k, v in e["props"].items()}}
            for e in sorted(edges, key=lambda e: e["eid"]) if e["src"] in inside and e["dst"] in inside
        ]
        return {"entities": entities, "relations": relations}


def _kind_name(v: Any, type_: str, name: str) -> str:
    if isinstance(v, bool):
        return "Bool"
    if isinstance(v, (int, float)):
        return "Number"
    if isinstance(v, list):
        return "List"
    return "Text"


def json_text(value: Column) -> Column:
    """The text that a JSON text holds."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def json_kind(value: Column) -> Column:
    """long, double, boolean, array, object, string or null of a JSON text, by its first character."""
    first = F.substring(F.trim(value), 1, 1)
    return (
        F.when(value.isNull() | (value == "null"), "null")
        .when(first == '"', "string").when(first == "[", "array").when(first == "{", "object").when(first.isin("t", "f"), "boolean")
        .when(F.rlike(value, F.lit(r"^-?\d+$")), "long").otherwise("double")
    )


def merge_kinds(kinds: set[str]) -> str:
    kinds = kinds - {"null"}
    if len(kinds) == 1:
        return next(iter(kinds))
    return "double" if kinds == {"long", "double"} else "string"


def from_json_text(value: Column, kind: str) -> Column:
    """A JSON text as a value of a kind."""
    if kind == "string":
        return F.when(F.startswith(value, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)
    if kind == "array":
        return F.from_json(value, "array<string>")
    if kind == "object":
        return value
    return value.try_cast({"long": "bigint", "double": "double", "boolean": "boolean"}[kind])
