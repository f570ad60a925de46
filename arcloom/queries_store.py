"""Registered queries of ingest, resolution, retrieval over the graph, and introspection, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import introspect, resolve, retrieve
from .operators.ingest import NODE_SCHEMA, GraphStore, doomed
from .plans.compile import Engine
from .plans.dsl import AllOf, AnyOf, EntityTypeQuery, Filter, Not, Settings, TraversalQuery, parse
from .queries import _COS, _first_vector, n, q, query, ret
from .sources.catalog import GraphCatalog
from .sources.tables import table_graph


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


class _Frames(GraphStore):
    """The merges of a store on frames alone."""

    def __init__(self, spark: SparkSession):
        self.spark, self.prefix = spark, None


def _customers(spark: SparkSession, sf_dir: str, idx: int, **props) -> DataFrame:
    """Customers as entity rows."""
    entries = [x for name, c in props.items() for x in (F.lit(name), c)]
    return _t(spark, sf_dir, "customer").select(
        (F.col("c_custkey") * 10 + idx).alias("idx"), F.col("c_custkey").cast("string").alias("local_id"), F.lit("Customer").alias("type"), F.lit(None).cast("string").alias("domain"),
        F.array(F.lit("table")).alias("scopes"), F.lit("id").alias("key_field"), F.lit(False).alias("soft"), F.col("c_custkey").cast("string").alias("key"), F.create_map(*entries).alias("props"),
    )


@query("merge_upsert_nodes", """SELECT CAST(c_custkey AS VARCHAR) AS key, '"' || c_name || '"' AS name, '"' || lower(c_mktsegment) || '"' AS segment, CAST(c_nationkey AS VARCHAR) AS nation, CAST(2 AS INTEGER) AS n_labels FROM customer""")
def merge_upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _Frames(spark)
    old = s.merge_nodes(spark.createDataFrame([], NODE_SCHEMA), _customers(spark, sf_dir, 0, name=_quoted(F.col("c_name")), segment=_quoted(F.col("c_mktsegment"))))
    later = _customers(spark, sf_dir, 1, segment=F.lit('"overwritten"')).unionByName(_customers(spark, sf_dir, 2, segment=_quoted(F.lower("c_mktsegment")), nation=F.col("c_nationkey").cast("string")))
    p = F.col("props")
    return s.merge_nodes(old, later).select("key", p["name"].alias("name"), p["segment"].alias("segment"), p["nation"].alias("nation"), F.size("labels").alias("n_labels"))


@query("merge_upsert_edges", """SELECT CAST(o_custkey AS VARCHAR) AS src, CAST(n_nationkey AS VARCHAR) AS dst, CAST(max(o_orderkey) AS VARCHAR) AS last FROM orders
 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")  # fmt: skip
def merge_upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _Frames(spark)
    cust = _customers(spark, sf_dir, 0, id=F.col("c_custkey").cast("string"))
    nation = _t(spark, sf_dir, "nation").select(
        (-F.col("n_nationkey") - 1).cast("long").alias("idx"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("local_id"), F.lit("Nation").alias("type"), F.lit(None).cast("string").alias("domain"),
        F.array().cast("array<string>").alias("scopes"), F.lit("id").alias("key_field"), F.lit(False).alias("soft"), F.col("n_nationkey").cast("string").alias("key"), F.create_map(F.lit("id"), F.col("n_nationkey").cast("string")).alias("props"),
    )
    entities = cust.unionByName(nation)
    nodes = entities.select(F.xxhash64("type", "key").alias("nid"), "type", "key_field", "key")
    bought = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("idx"), F.lit("BOUGHT_IN").alias("rel"), F.col("o_custkey").cast("string").alias("from_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("to_id"),
        F.create_map(F.lit("last"), F.col("o_orderkey").cast("string")).alias("props"),
    )
    dangling = bought.withColumn("to_id", F.lit("nowhere"))
    merged = s.merge_edges(spark.createDataFrame([], "eid long, rel string, src long, dst long, props map<string,string>"), nodes, entities, bought.unionByName(dangling))
    key = nodes.select("nid", "key")
    return merged.join(key.toDF("src", "a"), "src").join(key.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("props")["last"].alias("last"))


def _provenance(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as chunks of their source, and (language, length class) as entities that sources mention."""
    d = _t(spark, sf_dir, "documents")
    topic = F.concat("lang", F.lit("-"), F.floor(F.col("n_chars") / 500).cast("string"))
    name = F.create_map(F.lit("name"), _quoted(F.col("source")))
    empty = F.create_map().cast("map<string,string>")
    nodes = (
        d.select(F.xxhash64(F.lit("s"), "source").alias("nid"), F.lit("Source").alias("type"), F.col("source").alias("key"), name.alias("props")).dropDuplicates(["nid"])
        .unionByName(d.select(F.xxhash64(F.lit("c"), "doc_id").alias("nid"), F.lit("Chunk").alias("type"), F.col("doc_id").cast("string").alias("key"), empty.alias("props")))
        .unionByName(d.select(F.xxhash64(F.lit("e"), topic).alias("nid"), F.lit("Topic").alias("type"), topic.alias("key"), empty.alias("props")).dropDuplicates(["nid"]))
    )
    source = F.xxhash64(F.lit("s"), "source").alias("dst")
    edges = d.select(F.lit("part_of").alias("rel"), F.xxhash64(F.lit("c"), "doc_id").alias("src"), source).unionByName(
        d.select(F.lit("mention").alias("rel"), F.xxhash64(F.lit("e"), topic).alias("src"), source).distinct()
    )
    return nodes, edges


@query("delete_by_source", """WITH t AS (SELECT *, lang || '-' || CAST(n_chars // 500 AS VARCHAR) AS topic FROM documents)
SELECT 'source' AS why, 'src0' AS key UNION ALL SELECT 'chunk', CAST(doc_id AS VARCHAR) FROM t WHERE source = 'src0'
UNION ALL SELECT 'entity', topic FROM t GROUP BY topic HAVING min(source) = 'src0' AND max(source) = 'src0'""")  # fmt: skip
def delete_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _provenance(spark, sf_dir)
    return doomed(nodes, edges, "src0").join(nodes.select("nid", "key"), "nid").select("why", "key")


_GATES = """WITH p AS (SELECT a.n_nationkey AS idx, a.n_name AS x, b.n_nationkey AS hit, b.n_name AS y, 1 - abs(a.n_nationkey - b.n_nationkey) / 80.0 AS score FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey),
j AS (SELECT *, jaro_similarity(lower(x), lower(y)) AS js, row_number() OVER (PARTITION BY idx ORDER BY score DESC, hit) AS rank FROM p),
g AS (SELECT *, max(score) OVER (PARTITION BY idx) AS best FROM j),
h AS (SELECT *, sum(CASE WHEN rank > 1 AND best - score <= 0.03 THEN 1 ELSE 0 END) OVER (PARTITION BY idx) AS near, max(CASE WHEN rank = 2 THEN score END) OVER (PARTITION BY idx) AS second FROM g)
SELECT CAST(idx AS INTEGER) AS idx, CAST(hit AS INTEGER) AS hit,
 CASE WHEN coalesce(best - second < 0.04, false) OR near > 1 THEN 'review' ELSE 'merge' END AS outcome,
 list_filter([CASE WHEN coalesce(best - second < 0.04, false) THEN 'insufficient_margin' END, CASE WHEN near > 1 THEN 'too_many_close_candidates' END], lambda x: x IS NOT NULL) AS reasons
FROM h WHERE rank = 1"""


@query("soft_merge_gates", _GATES)
def soft_merge_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (_t(spark, sf_dir, "nation").toDF("k", "name", "region").select(*[F.col(c).alias(f"{x}_{c}") for c in ("k", "name", "region")]) for x in "ab")
    none = F.create_map().cast("map<string,string>")
    text = lambda c: F.concat(F.lit("type: Nation\nname: "), c)
    hits = a.join(b, F.col("a_region") == F.col("b_region")).select(
        F.col("a_k").alias("idx"), text(F.col("a_name")).alias("canonical"), none.alias("props"), F.col("b_k").alias("hit"), text(F.col("b_name")).alias("hit_canonical"), none.alias("hit_props"),
        (1 - F.abs(F.col("a_k") - F.col("b_k")) / 80.0).alias("score"),
    )
    return resolve.gates(hits, resolve.ResolveConfig(min_margin=0.04)).select("idx", "hit", "outcome", "reasons")


@query("in_batch_dedup")
def in_batch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clustering of the vectors of each label; order-dependent, so SQL cannot say it."""
    v = _t(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("idx"), F.col("label").cast("string").alias("type"), F.concat(F.lit("type: Vec\nname: v"), F.col("vec_id").cast("string")).alias("canonical"),
        F.create_map().cast("map<string,string>").alias("props"), F.col("embedding").cast("array<double>").alias("vec"),
    )
    cfg = resolve.ResolveConfig(similarity_threshold=0.5, review_threshold=0.4, auto_merge_threshold=0.6)
    return v.groupBy("type").applyInPandas(lambda pdf: resolve.cluster(pdf, cfg), "idx long, new_key string, outcome string, hit long, score double, reasons array<string>").select("idx", "new_key", "outcome", "hit")


class _OneVector:
    """An embedder that knows one vector, for queries with a given one."""

    def __init__(self, vec):
        self.vec, self.dim = [float(x) for x in vec], len(vec)

    def embed(self, texts):
        import numpy as np

        return np.array([self.vec for _ in texts])

    def column(self, c):
        return F.array(*[F.lit(x) for x in self.vec])


def _retrieval(spark: SparkSession, sf_dir: str) -> retrieve.RetrievalGraph:
    """Vectors of low labels are chunks, the others entities typed by label; a chunk mentions the entities next to it and has a source."""
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("nid"), F.col("label"), F.col("embedding").cast("array<double>").alias("vec"))
    low = v.where("label < 5")
    kind = F.concat(F.lit("T"), F.col("label").cast("string"))
    chunks = low.select("nid", F.concat(F.lit("c"), F.col("nid").cast("string")).alias("chunk_id"), F.concat(F.lit("text "), F.col("nid").cast("string")).alias("text"), "vec")
    entities = v.where("label >= 5").select("nid", kind.alias("type"), F.array(kind).alias("labels"), F.concat(F.lit("e"), F.col("nid").cast("string")).alias("text"), "vec")
    mentions = low.select(F.col("nid").alias("chunk"), F.explode(F.array(F.col("nid") + 1, F.col("nid") + 3)).alias("entity"))
    return retrieve.RetrievalGraph(entities, chunks, mentions, low.select(F.col("nid").alias("chunk"), (F.col("nid") % 7).alias("source")), spark.createDataFrame([(i, f"s{i}") for i in range(7)], "nid long, name string"))


_RAG = f"""WITH v AS (SELECT vec_id AS nid, label, {_COS} AS s FROM embeddings),
e AS (SELECT nid, s FROM v WHERE label >= 5 ORDER BY s DESC, nid LIMIT 50), c AS (SELECT nid, s FROM v WHERE label < 5 ORDER BY s DESC, nid LIMIT 50),
m AS (SELECT v.nid AS chunk, v.nid + d AS entity FROM v, (SELECT unnest([1, 3]) AS d) WHERE v.label < 5),
a AS (SELECT chunk, sum(s) AS es FROM m JOIN e ON e.nid = m.entity GROUP BY 1)
SELECT 'c' || CAST(coalesce(a.chunk, c.nid) AS VARCHAR) AS chunk_id, 's' || CAST(coalesce(a.chunk, c.nid) % 7 AS VARCHAR) AS source_name, round(coalesce(es, 0) + coalesce(s, 0), 6) AS score
FROM a FULL JOIN c ON a.chunk = c.nid ORDER BY coalesce(es, 0) + coalesce(s, 0) DESC, coalesce(a.chunk, c.nid) LIMIT 20"""


@query("rag_traversal", _RAG)
def rag_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = retrieve.traversal(_retrieval(spark, sf_dir), TraversalQuery((), "goal", limit=20), _OneVector(_first_vector(spark, sf_dir)))
    return got.select("chunk_id", "source_name", F.round("score", 6).alias("score"))


@query("entity_type_search", f"""WITH v AS (SELECT vec_id AS nid, label, {_COS} AS s FROM embeddings),
e AS (SELECT 'T' || CAST(label AS VARCHAR) AS entity_type, s FROM v WHERE label >= 5 AND s >= 0.1 ORDER BY s DESC, nid LIMIT 32), c AS (SELECT 'Chunk' AS entity_type, s FROM v WHERE label < 5 AND s >= 0.1 ORDER BY s DESC, nid LIMIT 32)
SELECT entity_type, round(max(s), 6) AS score FROM (SELECT * FROM e UNION ALL SELECT * FROM c) GROUP BY 1""")  # fmt: skip
def entity_type_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = retrieve.entity_types(_retrieval(spark, sf_dir), EntityTypeQuery("goal", score_threshold=0.1), _OneVector(_first_vector(spark, sf_dir)))
    return got.select("entity_type", F.round("score", 6).alias("score"))


_KINDS = {"INTEGER": "Int", "BIGINT": "Int", "DOUBLE": "Float", "TIMESTAMP": "Datetime", "VARCHAR": "String", "FLOAT[]": "List"}
_TABLES = {
    "Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "orders", "Event": "events", "Chunk": "documents", "Page": "pages",
    "BenchmarkItem": "benchmark", "Vec": "embeddings", "Label": "labels", "Turn": "conversations",
}
_TYPE_SQL = (
    "SELECT label, column_name AS property, CASE data_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " END AS type FROM (VALUES "
    + ", ".join(f"('{x}', '{t}')" for x, t in _TABLES.items()) + ") v(label, t) JOIN (SELECT DISTINCT table_name, column_name, data_type FROM duckdb_columns()) c ON c.table_name = v.t"
    " UNION ALL SELECT * FROM (VALUES ('Turn', 'turn_id', 'Int'), ('Source', 'name', 'String'))"
)


@query("introspect_types", _TYPE_SQL)
def introspect_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = introspect.introspect(table_graph(spark, sf_dir))
    return spark.createDataFrame([(k.label, p.name, p.type) for k in s.nodes for p in k.properties], "label string, property string, type string")


#: Text properties that are no identifiers by their name.
_ENUMS = (
    ("Customer", "c_mktsegment", "customer"), ("Part", "p_brand", "part"), ("Part", "p_type", "part"), ("Order", "o_orderstatus", "orders"), ("Order", "o_orderpriority", "orders"),
    ("Event", "event_type", "events"), ("Event", "props", "events"), ("Chunk", "lang", "documents"), ("Chunk", "source", "documents"), ("Page", "html", "pages"), ("Turn", "role", "conversations"),
)


@query(
    "enum_values",
    " UNION ALL ".join(
        f"SELECT '{x}' AS label, '{p}' AS property, v AS value FROM (SELECT DISTINCT lower(trim({p})) AS v FROM {t} WHERE {p} IS NOT NULL) WHERE v <> '' AND (SELECT count(DISTINCT lower(trim({p}))) FROM {t}) <= {introspect.ENUM_CAP}"
        for x, p, t in _ENUMS
    ),
)
def enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = introspect.introspect(table_graph(spark, sf_dir))
    rows = [(k.label, p.name, v) for k in s.nodes for p in k.properties for v in p.values]
    return spark.createDataFrame(rows, "label string, property string, value string")


@query("tenant_prefix", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def tenant_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    g = GraphCatalog(spark).add_node("Customer", c.withColumn("labels", F.array(F.lit("Customer"), F.col("c_mktsegment"))), "c_custkey", labels="labels")
    return Engine(g, Settings(max_limit=None, auto_sources=False)).plan(q(n("Customer", "c"), returns=[ret("c.c_custkey", "id")], prefix_label="BUILDING"))


@query("filter_tree", "SELECT p_partkey AS id FROM part WHERE (p_size < 5 OR starts_with(p_brand, 'Brand#1')) AND NOT (p_retailprice > 1200 AND p_size <> 3)")
def filter_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    where = AllOf((AnyOf((Filter("p.p_size", "lt", 5), Filter("p.p_brand", "starts_with", "Brand#1"))), Not(AllOf((Filter("p.p_retailprice", "gt", 1200), Filter("p.p_size", "neq", 3))))))
    base = parse(q(n("Part", "p"), returns=[ret("p.p_partkey", "id")]))
    return Engine(table_graph(spark, sf_dir), Settings(max_limit=None, auto_sources=False)).plan(replace(base, where=where))
