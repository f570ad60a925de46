"""The registered graph queries over the test tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .functions.types import Registry
from .operators import vector
from .operators.explore import Explorer
from .plans.compile import Engine
from .plans.dsl import Settings
from .plans.text import TextIndex
from .sources.tables import table_graph

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, types: dict | None = None, **settings: Any) -> Engine:
    return Engine(table_graph(spark, sf_dir), Settings(**({"max_limit": None, "auto_sources": False} | settings)), types=types)


def doc(name: str, document: dict, sql: str, types: dict | None = None, **settings: Any) -> None:
    """Registers a query document."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, types, **settings).plan(document)

    _QUERIES[name] = run
    _SQL[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import queries_more, queries_store  # noqa: F401 - register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries_more, queries_store  # noqa: F401

    return dict(_SQL)


# --- building blocks ---------------------------------------------------------


def n(label: str, alias: str) -> dict:
    return {"label": label, "alias": alias}


def hop(rel: str, label: str, alias: str, source: str | None = None, direction: str = "out", edge: str | None = None, depth: tuple[int, int] | None = None, optional: bool = False) -> dict:
    h: dict[str, Any] = {"edge": {"label": rel, "direction": direction} | ({"alias": edge} if edge else {}), "target": n(label, alias), "optional": optional}
    if source:
        h["from"] = source
    if depth:
        h["depth"] = {"min": depth[0], "max": depth[1]}
    return h


def flt(field: str, op: str, value: Any, type: str | None = None) -> dict:
    return {"field": field, "op": op, "value": value} | ({"type": type} if type else {})


def ret(field: str, alias: str | None = None, agg: str | None = None, part: str | None = None) -> dict:
    return {"field": field} | ({"alias": alias} if alias else {}) | ({"aggregate": agg} if agg else {}) | ({"date_part": part} if part else {})


def q(start: dict, hops: list | None = None, filters: list | None = None, returns: list | None = None, **rest: Any) -> dict:
    return {"start": start, "traversals": hops or [], "filters": filters or [], "return": returns or []} | rest


CUST = n("Customer", "c")
PLACED = hop("PLACED", "Order", "o", edge="p")
CO = "customer c JOIN orders o ON o.o_custkey = c.c_custkey"

FLAGSHIP = q(
    CUST, [PLACED], [flt("o.o_orderstatus", "eq", "F"), flt("o.o_totalprice", "gt", 1000)],
    [ret("c.c_custkey", "customer"), ret("c.c_name", "name"), ret("o.o_orderkey", "n_orders", "count"), ret("o.o_totalprice", "revenue", "sum")],
    group_by=["c.c_custkey", "c.c_name"], sort=[{"field": "revenue", "order": "desc"}, {"field": "customer"}], limit=10,
)
doc("aggregate_orders", FLAGSHIP, f"""SELECT c_custkey AS customer, c_name AS name, count(*) AS n_orders, sum(o_totalprice) AS revenue FROM {CO}
 WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY 1, 2 ORDER BY revenue DESC, customer LIMIT 10""")  # fmt: skip

# scans and projections
doc("scan_label", q(n("Nation", "n"), returns=[ret("n.n_nationkey", "id"), ret("n.n_name", "name")]), "SELECT n_nationkey AS id, n_name AS name FROM nation")
doc("scan_unknown_property_is_null", q(n("Region", "r"), returns=[ret("r.r_name", "name"), ret("r.nothing", "nothing")]), "SELECT r_name AS name, CAST(NULL AS VARCHAR) AS nothing FROM region")
_LABELS = {"Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "orders", "Event": "events", "Chunk": "documents", "Page": "pages",
           "BenchmarkItem": "benchmark", "Vec": "embeddings", "Label": "labels", "Turn": "conversations"}
doc("scan_any_label", q(n("", "x"), returns=[ret("x.label", "label"), ret("x", "n", "count")], group_by=["x.label"]),
    " UNION ALL ".join(f"SELECT '{x}' AS label, count(*) AS n FROM {t}" for x, t in _LABELS.items()) + " UNION ALL SELECT 'Source', count(DISTINCT source) FROM documents")
doc("project_date_part", q(n("Order", "o"), returns=[ret("o.o_orderkey", "id"), ret("o.o_orderdate", "y", part="year"), ret("o.o_orderdate", "q", part="quarter"), ret("o.o_orderdate", "m", part="month"), ret("o.o_orderdate", "d", part="day"), ret("o.o_orderdate", "h", part="hour")]),
    "SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h FROM orders")
doc("distinct_values", q(CUST, returns=[ret("c.c_mktsegment", "segment")], distinct=True), "SELECT DISTINCT c_mktsegment AS segment FROM customer")

# plain predicates
_P = n("Part", "p")
for _name, _op, _value, _where in (
    ("filter_eq", "eq", "Brand#11", "p_brand = 'Brand#11'"), ("filter_neq", "neq", "Brand#11", "p_brand <> 'Brand#11'"),
    ("filter_in", "in", ["Brand#11", "Brand#12"], "p_brand IN ('Brand#11', 'Brand#12')"), ("filter_contains", "contains", "#1", "contains(p_brand, '#1')"),
    ("filter_starts_with", "starts_with", "Brand#2", "starts_with(p_brand, 'Brand#2')"), ("filter_ends_with", "ends_with", "3", "ends_with(p_brand, '3')"),
    ("filter_case_matters", "contains", "brand", "contains(p_brand, 'brand')"),
    ("filter_eq_ci", "eq_ci", " bRAND#11 ", "lower(trim(p_brand)) = 'brand#11'"), ("filter_neq_ci", "neq_ci", "BRAND#11", "lower(trim(p_brand)) <> 'brand#11'"),
    ("filter_in_ci", "in_ci", ["BRAND#11", "brand#12"], "lower(trim(p_brand)) IN ('brand#11', 'brand#12')"), ("filter_contains_ci", "contains_ci", "AND#1", "contains(lower(trim(p_brand)), 'and#1')"),
    ("filter_starts_with_ci", "starts_with_ci", "BRAND#2", "starts_with(lower(trim(p_brand)), 'brand#2')"), ("filter_ends_with_ci", "ends_with_ci", "D#13", "ends_with(lower(trim(p_brand)), 'd#13')"),
):
    doc(_name, q(_P, filters=[flt("p.p_brand", _op, _value)], returns=[ret("p.p_partkey", "id"), ret("p.p_brand", "brand")]), f"SELECT p_partkey AS id, p_brand AS brand FROM part WHERE {_where}")
doc("filter_range", q(_P, filters=[flt("p.p_size", "gte", 10), flt("p.p_size", "lt", 20), flt("p.p_retailprice", "lte", 1500), flt("p.p_retailprice", "gt", 900.5)], returns=[ret("p.p_partkey", "id"), ret("p.p_size", "size")]),
    "SELECT p_partkey AS id, p_size AS size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice <= 1500 AND p_retailprice > 900.5")
doc("filter_in_empty", q(_P, filters=[flt("p.p_brand", "in", [])], returns=[ret("p", "n", "count")]), "SELECT CAST(0 AS BIGINT) AS n")
doc("filter_cross_type_order_is_null", q(_P, filters=[flt("p.p_brand", "gt", 5)], returns=[ret("p", "n", "count")]), "SELECT CAST(0 AS BIGINT) AS n")

# typed predicates
for _name, _op, _value, _where in (
    ("keyword_eq", "eq", "brand#11", "lower(trim(p_brand)) = 'brand#11'"), ("keyword_neq", "neq", "brand#11", "lower(trim(p_brand)) <> 'brand#11'"),
    ("keyword_in", "in", ["BRAND#11", "brand#12"], "lower(trim(p_brand)) IN ('brand#11', 'brand#12')"), ("keyword_contains", "contains", "AND#1", "contains(lower(trim(p_brand)), 'and#1')"),
    ("keyword_range", "gte", "Brand#3", "p_brand >= 'Brand#3'"), ("keyword_matches", "matches", "Brand#[12].", "regexp_full_match(p_brand, 'Brand#[12].')"),
    ("keyword_matches_whole", "regex", "rand", "regexp_full_match(p_brand, 'rand')"),
):
    doc(_name, q(_P, filters=[flt("p.p_brand", _op, _value, "Keyword")], returns=[ret("p.p_partkey", "id")]), f"SELECT p_partkey AS id FROM part WHERE {_where}")
doc("keyword_by_ontology", q(_P, filters=[flt("p.p_brand", "eq", "BRAND#11")], returns=[ret("p.p_partkey", "id")]), "SELECT p_partkey AS id FROM part WHERE lower(trim(p_brand)) = 'brand#11'", types={("Part", "p_brand"): "Keyword"})
_DAY = "TIMESTAMP '1996-03-01'"
for _op, _where in (
    ("eq", f"ts >= {_DAY} AND ts < {_DAY} + INTERVAL 1 DAY"), ("neq", f"ts < {_DAY} OR ts >= {_DAY} + INTERVAL 1 DAY"), ("gt", f"ts >= {_DAY} + INTERVAL 1 DAY"),
    ("gte", f"ts >= {_DAY}"), ("lt", f"ts < {_DAY}"), ("lte", f"ts < {_DAY} + INTERVAL 1 DAY"),
):
    _day = _where.replace("1996-03-01", "2024-01-10")
    doc(f"datetime_day_{_op}", q(n("Event", "e"), filters=[flt("e.ts", _op, "2024-01-10", "Timestamp")], returns=[ret("e.event_id", "id")]), f"SELECT event_id AS id FROM events WHERE {_day}")
doc("datetime_instant", q(n("Event", "e"), filters=[flt("e.ts", "gte", "2024-01-10T12:30:00Z", "Timestamp"), flt("e.ts", "lt", "2024-01-11 06:00", "Timestamp")], returns=[ret("e.event_id", "id")]),
    "SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:30:00' AND ts < TIMESTAMP '2024-01-11 06:00:00'")

# hops
doc("hop_out", q(CUST, [PLACED], returns=[ret("c.c_name", "name"), ret("o.o_orderkey", "ord")]), f"SELECT c_name AS name, o_orderkey AS ord FROM {CO}")
doc("hop_in", q(n("Order", "o"), [hop("PLACED", "Customer", "c", direction="in")], [flt("o.o_orderpriority", "eq", "1-URGENT")], [ret("o.o_orderkey", "ord"), ret("c.c_name", "name")]),
    f"SELECT o_orderkey AS ord, c_name AS name FROM {CO} WHERE o_orderpriority = '1-URGENT'")
doc("hop_direction_corrected", q(n("Order", "o"), [hop("PLACED", "Customer", "c")], returns=[ret("o", "n", "count")]), f"SELECT count(*) AS n FROM {CO}")
doc("hop_both", q(n("Turn", "a"), [hop("NEXT_TURN", "Turn", "b", direction="both")], returns=[ret("a.turn_id", "a"), ret("b.turn_id", "b")]),
    """WITH t AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn FROM conversations), e AS (SELECT x.id AS s, y.id AS d FROM t x JOIN t y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)
 SELECT s AS a, d AS b FROM e UNION ALL SELECT d, s FROM e WHERE s <> d""")  # fmt: skip
doc("hop_chain", q(n("Region", "r"), [hop("IN_REGION", "Nation", "n", direction="in"), hop("FROM_NATION", "Customer", "c", "n", "in"), hop("PLACED", "Order", "o", "c")], returns=[ret("r.r_name", "region"), ret("o.o_totalprice", "total", "sum"), ret("o", "n", "count")], group_by=["r.r_name"]),
    f"SELECT r_name AS region, sum(o_totalprice) AS total, count(*) AS n FROM {CO} JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
doc("hop_siblings", q(n("Nation", "n"), [hop("FROM_NATION", "Supplier", "s", direction="in"), hop("IN_REGION", "Region", "r")], returns=[ret("n.n_name", "nation"), ret("s.s_name", "supplier"), ret("r.r_name", "region")]),
    "SELECT n_name AS nation, s_name AS supplier, r_name AS region FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
doc("hop_sibling_edges_may_repeat", q(n("Nation", "n"), [hop("FROM_NATION", "Supplier", "a", direction="in"), hop("FROM_NATION", "Supplier", "b", direction="in")], returns=[ret("n.n_name", "nation"), ret("a", "n", "count")], group_by=["n.n_name"]),
    "SELECT n_name AS nation, count(*) AS n FROM nation JOIN supplier a ON a.s_nationkey = n_nationkey JOIN supplier b ON b.s_nationkey = n_nationkey GROUP BY 1")
doc("trail_uniqueness", q(n("Supplier", "a"), [hop("FROM_NATION", "Nation", "n"), hop("FROM_NATION", "Supplier", "b", "n", "in")], returns=[ret("a.s_name", "a"), ret("b.s_name", "b")]),
    "SELECT a.s_name AS a, b.s_name AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
doc("hop_edge_union", q(n("Order", "o"), [hop("CONTAINS|SHIPPED_BY", "", "x")], returns=[ret("x.label", "label"), ret("x", "n", "count")], group_by=["x.label"]),
    "SELECT 'Part' AS label, count(*) AS n FROM lineitem UNION ALL SELECT 'Supplier', count(*) FROM lineitem")
doc("hop_any_target", q(n("Nation", "n"), [hop("FROM_NATION", "", "x", direction="in")], returns=[ret("n.n_name", "nation"), ret("x.label", "label"), ret("x", "n", "count")], group_by=["n.n_name", "x.label"]),
    "SELECT n_name AS nation, 'Customer' AS label, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT n_name, 'Supplier', count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
doc("edge_property_filter", q(n("Order", "o"), [hop("CONTAINS", "Part", "p", edge="l")], [flt("l.l_quantity", "gte", 45), flt("l.l_returnflag", "eq", "R")], [ret("o.o_orderkey", "ord"), ret("p.p_name", "part"), ret("l.l_quantity", "qty")]),
    "SELECT o_orderkey AS ord, p_name AS part, l_quantity AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 45 AND l_returnflag = 'R'")
_OPT = hop("BY_USER", "Event", "e", direction="in", optional=True)
doc("hop_optional", q(CUST, [_OPT], returns=[ret("c.c_custkey", "id"), ret("e.event_id", "event")]), "SELECT c_custkey AS id, event_id AS event FROM customer LEFT JOIN events ON user_id = c_custkey")
doc("hop_optional_count", q(CUST, [_OPT], returns=[ret("c.c_custkey", "id"), ret("e.value", "n", "count")], group_by=["c.c_custkey"]), "SELECT c_custkey AS id, count(event_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
doc("hop_optional_filter", q(CUST, [_OPT], [flt("e.event_type", "eq", "click")], [ret("c.c_custkey", "id"), ret("e.event_id", "event")]), "SELECT c_custkey AS id, event_id AS event FROM customer JOIN events ON user_id = c_custkey WHERE event_type = 'click'")
doc("hop_optional_filter_strict", q(CUST, [_OPT], [flt("e.event_type", "eq", "click")], [ret("c.c_custkey", "id"), ret("e.event_id", "event")]),
    "SELECT c_custkey AS id, event_id AS event FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'click'", strict_optional_where=True)

# paths
_E = "e AS (SELECT x.conv_id * 1000 + x.turn AS s, y.conv_id * 1000 + y.turn AS d FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"
_B = "b AS (SELECT s, d, d AS k FROM e UNION ALL SELECT d, s, d FROM e)"


def _paths(low: int, high: int, table: str, both: bool = False) -> str:
    parts = []
    for k in range(low, high + 1):
        joins = f"{table} e1" + "".join(f" JOIN {table} e{i} ON e{i - 1}.d = e{i}.s" for i in range(2, k + 1))
        apart = " AND ".join(f"e{i}.k <> e{j}.k" for i in range(1, k + 1) for j in range(1, i)) if both and k > 1 else "true"
        parts.append(f"SELECT e1.s AS a, e{k}.d AS b, {k} AS hops FROM {joins} WHERE {apart}")
    return " UNION ALL ".join(parts)


for _low, _high in ((1, 2), (2, 3), (1, 4), (1, 6)):
    doc(f"varlen_{_low}_{_high}", q(n("Turn", "a"), [hop("NEXT_TURN", "Turn", "b", depth=(_low, _high))], returns=[ret("a.turn_id", "a"), ret("b.turn_id", "b")]), f"WITH {_E} SELECT a, b FROM ({_paths(_low, _high, 'e')})")
doc("varlen_both", q(n("Turn", "a"), [hop("NEXT_TURN", "Turn", "b", direction="both", depth=(1, 3))], returns=[ret("a.turn_id", "a"), ret("b", "n", "count")], group_by=["a.turn_id"]),
    f"WITH {_E}, {_B} SELECT a, count(*) AS n FROM ({_paths(1, 3, 'b', True)}) GROUP BY 1")
doc("varlen_optional", q(n("Turn", "a"), [hop("NEXT_TURN", "Turn", "b", depth=(2, 3), optional=True)], returns=[ret("a.turn_id", "a"), ret("b.turn_id", "b")]),
    f"WITH {_E}, t AS (SELECT conv_id * 1000 + turn AS id FROM conversations), p AS ({_paths(2, 3, 'e')}) SELECT t.id AS a, p.b FROM t LEFT JOIN p ON p.a = t.id")
doc("varlen_edge_list", q(n("Turn", "a"), [hop("NEXT_TURN", "Turn", "b", edge="r", depth=(1, 3))], returns=[ret("a.turn_id", "a"), ret("r", "n", "count")], group_by=["a.turn_id"]),
    f"WITH {_E} SELECT a, count(*) AS n FROM ({_paths(1, 3, 'e')}) GROUP BY 1")

# aggregation, grouping, order
doc("agg_all", q(n("Order", "o"), returns=[ret("o.o_totalprice", "n", "count"), ret("o.o_totalprice", "s", "sum"), ret("o.o_totalprice", "a", "avg"), ret("o.o_totalprice", "lo", "min"), ret("o.o_totalprice", "hi", "max")]),
    "SELECT count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
doc("agg_collect", q(n("Region", "r"), [hop("IN_REGION", "Nation", "n", direction="in")], returns=[ret("r.r_name", "region"), ret("n.n_name", "nations", "collect")], group_by=["r.r_name"]),
    "SELECT r_name AS region, list_sort(list(n_name)) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
doc("agg_count_bindings", q(n("Region", "r"), returns=[ret("r.nothing", "n", "count")]), "SELECT count(*) AS n FROM region")
doc("agg_sum_of_nothing", q(n("Order", "o"), filters=[flt("o.o_totalprice", "lt", 0)], returns=[ret("o.o_totalprice", "s", "sum"), ret("o.o_totalprice", "a", "avg"), ret("o", "n", "count")]),
    "SELECT CAST(0 AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS a, CAST(0 AS BIGINT) AS n")
doc("group_multi_key", q(n("Order", "o"), returns=[ret("o.o_orderstatus", "st"), ret("o.o_orderpriority", "prio"), ret("o", "n", "count"), ret("o.o_totalprice", "total", "sum")], group_by=["o.o_orderstatus", "o.o_orderpriority"]),
    "SELECT o_orderstatus AS st, o_orderpriority AS prio, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2")
doc("group_implicit_key", q(n("Order", "o"), returns=[ret("o.o_orderstatus", "st"), ret("o", "n", "count")], group_by=[{"field": "o.o_orderpriority", "alias": "prio"}]),
    "SELECT o_orderstatus AS st, o_orderpriority AS prio, count(*) AS n FROM orders GROUP BY 1, 2")
for _part in ("year", "quarter", "month", "day", "hour"):
    _key = {"field": "e.ts", "date_part": _part, "alias": "part"}
    doc(f"group_{_part}", q(n("Event", "e"), returns=[ret("e", "n", "count"), ret("e.value", "v", "sum")], group_by=[_key]), f"SELECT CAST({_part}(ts) AS INTEGER) AS part, count(*) AS n, sum(value) AS v FROM events GROUP BY 1")
doc("sort_nulls_last", q(CUST, [_OPT], returns=[ret("c.c_custkey", "id"), ret("e.value", "top", "max")], group_by=["c.c_custkey"], sort=[{"field": "top", "order": "desc"}, {"field": "id"}], limit=1000000),
    "SELECT c_custkey AS id, max(value) AS top FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1 ORDER BY top DESC NULLS LAST, id")
doc("sort_unprojected_top", q(n("Order", "o"), returns=[ret("o.o_orderkey", "id")], sort=[{"field": "o.o_totalprice", "order": "desc"}, {"field": "id"}], limit=25),
    "SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
doc("limit_capped", q(n("Order", "o"), returns=[ret("o.o_orderkey", "id")], sort=[{"field": "id"}], limit=100000), "SELECT o_orderkey AS id FROM orders ORDER BY 1 LIMIT 5000", max_limit=5000)

# provenance
doc("sources_column", q(n("Chunk", "d"), filters=[flt("d.lang", "eq", "de")], returns=[ret("d.doc_id", "id")]), "SELECT doc_id AS id, CASE WHEN source IS NULL THEN [] ELSE [source] END AS sources FROM documents WHERE lang = 'de'", auto_sources=True)
doc("implicit_dedup", q(n("Chunk", "d"), [hop("part_of", "Source", "s")], returns=[ret("d.doc_id", "id"), ret("s.name", "source")]), "SELECT doc_id AS id, source, [source] AS sources FROM documents WHERE source IS NOT NULL", auto_sources=True)

# retrieval
_VEC = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").select("embedding").first()[0]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("nid"), F.col("embedding").alias("vec"))


_COS = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_VEC} AS DOUBLE[]))"


@query("knn_dense", f"SELECT vec_id AS nid, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 20")
def knn_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.knn(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 20).withColumn("score", F.round("score", 6))


@query("knn_threshold", f"SELECT vec_id AS nid, round({_COS}, 6) AS score FROM embeddings WHERE {_COS} >= 0.25 ORDER BY {_COS} DESC, vec_id LIMIT 50")
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.knn(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 50, 0.25).withColumn("score", F.round("score", 6))


@query("knn_batch", """SELECT l.label AS qid, e.vec_id AS nid, e.score FROM (SELECT DISTINCT label FROM embeddings) l, LATERAL (
 SELECT vec_id, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST((SELECT max(embedding) FROM embeddings z WHERE z.label = l.label) AS DOUBLE[])), 6) AS score
 FROM embeddings x ORDER BY score DESC, vec_id LIMIT 5) e""")  # fmt: skip
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy(F.col("label").alias("qid")).agg(F.max("embedding").alias("qvec"))
    pairs = vector.knn_batch(asked, _vectors(spark, sf_dir), 5)
    return pairs.withColumn("score", F.round("score", 6))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("nid"), "text").where("text is not null")


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_TERMS = ("thing", "the", "for")
_BM25 = f"""t AS (SELECT doc_id AS nid, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT nid, {', '.join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(_TERMS))} FROM t),
d AS (SELECT count(*) AS n, {', '.join(f'count(*) FILTER (t{i} > 0) AS d{i}' for i in range(len(_TERMS)))} FROM c),
s AS (SELECT nid, {' + '.join(f't{i} * ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5))' for i in range(len(_TERMS)))} AS score FROM c, d WHERE {' OR '.join(f't{i} > 0' for i in range(len(_TERMS)))})"""


@query("bm25_search", f"WITH {_BM25} SELECT nid, round(score, 6) AS score FROM s ORDER BY score DESC, nid LIMIT 30")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.bm25(_docs(spark, sf_dir), " ".join(_TERMS), 30).withColumn("score", F.round("score", 6))


@query("bm25_batch")
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"))
    return vector.bm25_batch(asked, _docs(spark, sf_dir), 5).withColumn("score", F.round("score", 6))


@query("hybrid_rrf", f"""WITH {_BM25}, x AS (SELECT vec_id AS nid, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 40), y AS (SELECT * FROM s ORDER BY score DESC, nid LIMIT 40),
 r AS (SELECT nid, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, nid)) AS p FROM x UNION ALL SELECT nid, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, nid)) FROM y)
 SELECT nid, round(sum(p), 6) AS score FROM r GROUP BY 1 ORDER BY sum(p) DESC, nid LIMIT 10""")  # fmt: skip
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = vector.knn(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 40)
    lexical = vector.bm25(_docs(spark, sf_dir), " ".join(_TERMS), 40)
    return vector.rrf([dense, lexical], 10).withColumn("score", F.round("score", 6))


@query("maxsim_chunks")
def maxsim_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.maxsim(_docs(spark, sf_dir), vector.HashingEmbedder(), "the thing and the other", 20).withColumn("score", F.round("score", 6))


def _text_engine(spark: SparkSession, sf_dir: str, **settings: Any) -> Engine:
    e = engine(spark, sf_dir, **settings)
    e.indexes["Chunk"] = TextIndex(e.catalog.nodes["Chunk"].df, "doc_id", "text")
    return e


@query("text_lexical_many", f"WITH {_BM25.replace(_TERMS[0], 'thing')} SELECT nid AS id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score DESC, nid LIMIT 20)")
def text_lexical_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _text_engine(spark, sf_dir, grounding=True)
    df = e.plan(q(n("Chunk", "d"), filters=[flt("d.text", "contains", "thing", "SemanticText"), flt("d.text", "contains", "the for", "SemanticText")], returns=[ret("d.doc_id", "id")]))
    return df.withColumn("score", F.round("score", 6))


@query("text_lexical_one", f"WITH {_BM25} SELECT nid AS id, round(score, 6) AS score FROM s ORDER BY score DESC, nid LIMIT 1")
def text_lexical_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _text_engine(spark, sf_dir, grounding=True)
    return e.plan(q(n("Chunk", "d"), filters=[flt("d.text", "eq", "thing the for", "SemanticText")], returns=[ret("d.doc_id", "id")])).withColumn("score", F.round("score", 6))


@query("text_dense_threshold")
def text_dense_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _text_engine(spark, sf_dir, search_threshold=0.3)
    return e.plan(q(n("Chunk", "d"), [hop("part_of", "Source", "s")], [flt("d.text", "search", "the thing and the other", "SemanticText")], [ret("d.doc_id", "id"), ret("s.name", "source")])).withColumn("score", F.round("score", 6))


# exploration
def _explorer(spark: SparkSession, sf_dir: str) -> Explorer:
    return Explorer(engine(spark, sf_dir))


_COUNTS = """SELECT * FROM (
 SELECT 'type' AS kind, name, n AS count FROM (SELECT 'Region' AS name, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer
  UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Event', count(*) FROM events
  UNION ALL SELECT 'Page', count(*) FROM pages UNION ALL SELECT 'BenchmarkItem', count(*) FROM benchmark UNION ALL SELECT 'Vec', count(*) FROM embeddings UNION ALL SELECT 'Label', count(*) FROM labels UNION ALL SELECT 'Turn', count(*) FROM conversations))
 UNION ALL SELECT 'relation', name, n FROM (SELECT 'IN_REGION' AS name, count(n_regionkey) AS n FROM nation UNION ALL SELECT 'FROM_NATION', (SELECT count(c_nationkey) FROM customer) + (SELECT count(s_nationkey) FROM supplier)
  UNION ALL SELECT 'PLACED', count(o_custkey) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SHIPPED_BY', count(*) FROM lineitem
  UNION ALL SELECT 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'BY_USER', count(user_id) FROM events UNION ALL SELECT 'NEXT_TURN', count(*) FROM conversations WHERE turn > 0)"""


@query("explore_overview", f"WITH c AS ({_COUNTS}) SELECT * FROM c UNION ALL SELECT 'total', kind, CAST(sum(count) AS BIGINT) FROM c GROUP BY kind")
def explore_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explorer(spark, sf_dir).overview()


@query("explore_relation_summary", """SELECT 'Nation' AS node_type, CAST(n_nationkey AS VARCHAR) AS node, 'FROM_NATION' AS rel, 'in' AS direction, 'Customer' AS other_type, count(*) AS count FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey
 UNION ALL SELECT 'Nation', CAST(n_nationkey AS VARCHAR), 'FROM_NATION', 'in', 'Supplier', count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey
 UNION ALL SELECT 'Nation', CAST(n_nationkey AS VARCHAR), 'IN_REGION', 'out', 'Region', 1 FROM nation""")  # fmt: skip
def explore_relation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explorer(spark, sf_dir).relation_summary(label="Nation")


@query("explore_neighbors", """SELECT 'PLACED' AS rel, 'out' AS direction, 'Order' AS type, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey = 7
 UNION ALL SELECT 'FROM_NATION', 'out', 'Nation', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'BY_USER', 'in', 'Event', CAST(event_id AS VARCHAR) FROM events WHERE user_id = 7""")  # fmt: skip
def explore_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explorer(spark, sf_dir).neighbors(7, "Customer", limit=None).select("rel", "direction", "type", "id")


@query("explore_entity_card", "SELECT CAST(n_nationkey AS VARCHAR) AS id, 'Nation' AS type, n_name AS name FROM nation WHERE n_nationkey = 3")
def explore_entity_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explorer(spark, sf_dir).entity(3, "Nation").select("id", "type", "name")


@query("explore_table_page", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer ORDER BY c_name, id LIMIT 50 OFFSET 100")
def explore_table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explorer(spark, sf_dir).entities_of_type("Customer", 50, 100)[0].select("id", "name")


#: Label, table, public id and text columns.
TEXTS = (
    ("Region", "region", "r_regionkey", ("r_name",)), ("Nation", "nation", "n_nationkey", ("n_name",)), ("Customer", "customer", "c_custkey", ("c_name", "c_mktsegment")),
    ("Supplier", "supplier", "s_suppkey", ("s_name",)), ("Part", "part", "p_partkey", ("p_name", "p_brand", "p_type")), ("Order", "orders", "o_orderkey", ("o_orderstatus", "o_orderpriority")),
    ("Event", "events", "event_id", ("event_type", "props")), ("Page", "pages", "page_id", ("url", "html")), ("BenchmarkItem", "benchmark", "item_id", ("text",)),
    ("Turn", "conversations", "conv_id * 1000 + turn", ("role", "text")), ("Source", "(SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL)", "name", ("name",)),
)


@query("explore_keyword_search", " UNION ALL ".join(f"SELECT '{x}' AS type, CAST({i} AS VARCHAR) AS id FROM {t} WHERE " + " OR ".join(f"coalesce(contains(lower(trim({c})), 'as'), false)" for c in cs) for x, t, i, cs in TEXTS))
def explore_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explorer(spark, sf_dir).keyword("AS").select("type", "id")


@query("explore_keyword_exact", " UNION ALL ".join(f"SELECT '{x}' AS type, CAST({i} AS VARCHAR) AS id FROM {t} WHERE " + " OR ".join(f"coalesce({c} = 'user', false)" for c in cs) for x, t, i, cs in TEXTS))
def explore_keyword_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explorer(spark, sf_dir).search("user", mode="keyword", exact=True, limit=None).select("type", "id")


@query("explore_edges_among", "SELECT 'IN_REGION' AS rel, CAST(n_nationkey AS VARCHAR) AS src, CAST(n_regionkey AS VARCHAR) AS dst FROM nation")
def explore_edges_among(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _explorer(spark, sf_dir)
    nations = e.g.nodes["Nation"].df.select(F.lit("Nation").alias("type"), F.col("n_nationkey").alias("nid"))
    regions = e.g.nodes["Region"].df.select(F.lit("Region").alias("type"), F.col("r_regionkey").alias("nid"))
    return e.edges_among(nations.union(regions)).select("rel", "src", "dst")


@query("explore_timeline", "SELECT CAST(epoch(o_orderdate) AS BIGINT) AS epoch, CAST(o_orderkey AS VARCHAR) AS id, 'o_orderdate' AS property FROM orders WHERE o_orderdate IS NOT NULL")
def explore_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explorer(spark, sf_dir).timeline("Order").select("epoch", "id", "property")


# scalar functions
@query("canonical_text", "SELECT c_custkey AS id, 'type: Customer' || chr(10) || 'c_mktsegment: ' || c_mktsegment || chr(10) || 'c_name: ' || c_name AS text FROM customer")
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    props = F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("c_mktsegment"), F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("id"), scalars.canonical_text(F.lit("Customer"), props).alias("text"))


_JW = "jaro_similarity(a, b) + 0.1 * pre * (1 - jaro_similarity(a, b))"
_PRE = "CASE WHEN substr(a,1,4) = substr(b,1,4) AND length(a) > 3 AND length(b) > 3 THEN 4 WHEN substr(a,1,3) = substr(b,1,3) AND length(a) > 2 AND length(b) > 2 THEN 3 WHEN substr(a,1,2) = substr(b,1,2) AND length(a) > 1 AND length(b) > 1 THEN 2 WHEN substr(a,1,1) = substr(b,1,1) THEN 1 ELSE 0 END"


@query("jaro_winkler", f"SELECT a, b, round({_JW}, 6) AS jw FROM (SELECT *, {_PRE} AS pre FROM (SELECT x.n_name AS a, y.n_name AS b FROM nation x, nation y))")
def jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name")
    pairs = names.toDF("a").crossJoin(names.toDF("b"))
    return pairs.withColumn("jw", F.round(scalars.jaro_winkler("a", "b"), 6))


@query("sentence_split", r"""SELECT doc_id AS id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')) AS n
 FROM documents WHERE text IS NOT NULL""")  # fmt: skip
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return d.select(F.col("doc_id").alias("id"), F.size(scalars.sentences(F.col("text"))).cast("long").alias("n"))


@query("shadow_normalize", "SELECT p_partkey AS id, lower(trim(p_name)) AS norm FROM part")
def shadow_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), scalars.normalized(F.col("p_name")).alias("norm"))


@query("list_contains_any", "SELECT doc_id AS id FROM documents WHERE len(list_filter(string_split(text, ' '), lambda x: contains(lower(x), 'idiot'))) > 0")
def list_contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", " ").alias("w"))
    h = Registry().get("List")
    return d.where(h.predicate(F.col("w"), d.schema["w"].dataType, "contains", "IDIOT")).select(F.col("doc_id").alias("id"))
