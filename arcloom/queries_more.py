"""Registered queries of retrieval by text, provenance on any alias, the explorer's whole results, validation, ingest and the front end, with their SQL."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import GraphError
from .functions import scalars
from .operators import introspect, resolve, retrieve, vector
from .operators.explore import Explorer, bucket_of
from .operators.ingest import GraphStore
from .plans import dsl, language
from .plans.compile import Engine
from .plans.dsl import EntityTypeQuery, Settings, TraversalQuery
from .plans.text import TextIndex
from .queries import _COS, _SQL, CUST, PLACED, _docs, _explorer, _first_vector, engine, flt, hop, n, q, query, ret
from .queries_store import _OneVector, _retrieval, _t
from .sources import ontology as onto
from .sources.catalog import CHUNK, SOURCE, GraphCatalog
from .sources.graph_json import GraphBuilder, parse_graph, to_frames
from .sources.tables import table_graph
from .sources.vectors import VectorStore


def _folder(spark: SparkSession, what: str) -> str:
    """A fresh folder in the shared folder of the cluster; a local one where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise GraphError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"arcloom-checkpoint-{os.getuid()}")
    return f"{root}/{what}-{uuid.uuid4().hex}"


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"


def _values(rows: list[tuple], *names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({', '.join(names)})"


# --- retrieval by text: the hashing embedder in SQL ----------------------------


def _embedded(name: str, source: str) -> str:
    """CTEs of the vectors of source (nid, text) by place, and of their lengths."""
    return rf"""{name}_h AS (SELECT nid, ('0x' || substr(md5(w), 1, 8))::UBIGINT AS h FROM (SELECT nid, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM {source})),
{name}_v AS (SELECT nid, h % 64 AS d, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM {name}_h GROUP BY 1, 2),
{name}_n AS (SELECT nid, sqrt(sum(v * v)) AS n FROM {name}_v GROUP BY 1)"""


def _dense(text: str, source: str = "(SELECT doc_id AS nid, text FROM documents WHERE text IS NOT NULL)") -> str:
    """CTE cos (nid, score) of every row of source by cosine with text."""
    return f"""{_embedded("a", source)}, {_embedded("b", f"(SELECT 0 AS nid, '{text}' AS text)")},
cos AS (SELECT s.nid, coalesce(c.dot / nullif(a_n.n * (SELECT n FROM b_n), 0), 0) AS score FROM {source} s LEFT JOIN a_n ON a_n.nid = s.nid
 LEFT JOIN (SELECT a_v.nid, sum(a_v.v * b_v.v) AS dot FROM a_v JOIN b_v ON a_v.d = b_v.d GROUP BY 1) c ON c.nid = s.nid)"""


_ASKED = "the thing for the day"
_TERMS_ASKED = {"the": 2, "thing": 1, "for": 1, "day": 1}
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


def _lexical(terms: dict[str, int]) -> str:
    """CTE lex (nid, score) by BM25 over the documents."""
    return f"""l_t AS (SELECT doc_id AS nid, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
l_c AS (SELECT nid, {', '.join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(terms))} FROM l_t),
l_d AS (SELECT count(*) AS n, {', '.join(f'count(*) FILTER (t{i} > 0) AS d{i}' for i in range(len(terms)))} FROM l_c),
lex AS (SELECT nid, {' + '.join(f'{m} * t{i} * ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5))' for i, m in enumerate(terms.values()))} AS score FROM l_c, l_d WHERE {' OR '.join(f't{i} > 0' for i in range(len(terms)))})"""


def _hybrid(text: str, terms: dict[str, int], k: int) -> str:
    """CTE hyb (nid, score) of the k best by reciprocal rank fusion."""
    m = vector.PREFETCH * k
    ranked = lambda t: f"SELECT nid, 1.0 / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, nid)) AS p FROM (SELECT * FROM {t} ORDER BY round(score, 9) DESC, nid LIMIT {m})"
    return f"""{_dense(text)}, {_lexical(terms)},
hyb AS (SELECT nid, sum(p) AS score FROM ({ranked('cos')} UNION ALL {ranked('lex')}) GROUP BY 1 ORDER BY round(sum(p), 12) DESC, nid LIMIT {k})"""


def _index(spark: SparkSession, sf_dir: str, **settings) -> Engine:
    e = engine(spark, sf_dir, **settings)
    e.indexes["Chunk"] = TextIndex(e.catalog.nodes["Chunk"].df, "doc_id", "text")
    return e


def _found(op: str, value, hops: list | None = None, returns: list | None = None, **rest) -> dict:
    return q(n("Chunk", "d"), hops, [flt("d.text", op, value, "SemanticText") | rest], returns or [ret("d.doc_id", "id")])


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


_SQL["text_dense_threshold"] = f"""WITH {_dense("type: Chunk" + chr(10) + "text: the thing and the other")},
k AS (SELECT * FROM cos WHERE score >= 0.3 ORDER BY round(score, 9) DESC, nid LIMIT 40)
SELECT nid AS id, source, round(score, 6) AS score FROM k JOIN documents ON doc_id = nid WHERE source IS NOT NULL"""

_SQL["maxsim_chunks"] = rf"""WITH s AS (SELECT doc_id * 100000 + generate_subscripts(x, 1) AS nid, unnest(x) AS text FROM (SELECT doc_id, list_filter(list_transform(
 regexp_split_to_array(regexp_replace(text, '([.!?])', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS x FROM documents WHERE text IS NOT NULL)),
{_dense("the thing and the other", "s")}
SELECT nid // 100000 AS nid, round(max(score), 6) AS score FROM cos GROUP BY 1 ORDER BY round(max(score), 9) DESC, 1 LIMIT 20"""

_SQL["bm25_batch"] = f"""WITH t AS (SELECT doc_id AS nid, unnest({_TOKENS}) AS term FROM documents WHERE text IS NOT NULL), p AS (SELECT term, nid, count(*) AS tf FROM t GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
a AS (SELECT qid, term, count(*) AS tq FROM (SELECT item_id AS qid, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT qid, nid, sum(tq * tf * ln(1 + (n - df + 0.5) / (df + 0.5))) AS score FROM a JOIN p USING (term) JOIN d USING (term), n GROUP BY 1, 2)
SELECT qid, nid, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, nid) AS r FROM s) WHERE r <= 5"""


@query("hybrid_search", f"WITH {_hybrid(_ASKED, _TERMS_ASKED, 10)} SELECT nid, round(score, 6) AS score FROM hyb")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vector.HashingEmbedder()
    return _scored(vector.hybrid(_docs(spark, sf_dir), _ASKED, e.embed([_ASKED])[0], 10, embedder=e))


def _stored_documents(spark: SparkSession, sf_dir: str) -> VectorStore:
    s = VectorStore(spark, _folder(spark, "vectors"))
    s.upsert("docs", _docs(spark, sf_dir).select("nid", F.lit("Chunk").alias("label"), "text"))
    return s


@query("bm25_indexed", f"WITH {_lexical(_TERMS_ASKED)} SELECT nid, round(score, 6) AS score FROM lex ORDER BY round(score, 9) DESC, nid LIMIT 25")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_stored_documents(spark, sf_dir).search("docs", _ASKED, 25, mode="lexical"))


@query("hybrid_indexed", f"WITH {_hybrid(_ASKED, _TERMS_ASKED, 12)} SELECT nid, round(score, 6) AS score FROM hyb")
def hybrid_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_stored_documents(spark, sf_dir).search("docs", _ASKED, 12, mode="hybrid"))


@query("vector_store_search", f"WITH {_dense(_ASKED)} SELECT nid, round(score, 6) AS score FROM cos WHERE nid % 2 = 0 AND score >= 0.2 ORDER BY round(score, 9) DESC, nid LIMIT 15")
def vector_store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, insert again, delete, search."""
    s = VectorStore(spark, _folder(spark, "vectors"))
    docs = _docs(spark, sf_dir).select("nid", F.lit("Chunk").alias("label"), "text")
    s.upsert("docs", docs.withColumn("text", F.lit("old words")))
    s.upsert("docs", docs)
    s.delete("docs", docs.where("nid % 2 = 1").select("nid"))
    return _scored(s.search("docs", _ASKED, 15, 0.2))


@query("text_hybrid_grounded", f"WITH {_hybrid('type: Chunk' + chr(10) + 'text: ' + _ASKED, {'type': 1, 'chunk': 1, 'text': 1} | _TERMS_ASKED, 20)} SELECT nid AS id, round(score, 6) AS score FROM hyb")
def text_hybrid_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_index(spark, sf_dir, grounding=True).plan(_found("search", _ASKED)))


@query("text_fallback_one", f"""WITH {_hybrid('type: Chunk' + chr(10) + 'text: ' + _ASKED, {'type': 1, 'chunk': 1, 'text': 1} | _TERMS_ASKED, 40)}
SELECT nid AS id, round(cos.score, 6) AS score FROM hyb JOIN cos USING (nid) WHERE cos.score >= 0.1 ORDER BY round(cos.score, 9) DESC, nid LIMIT 1""")  # fmt: skip
def text_fallback_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_index(spark, sf_dir, reranker_threshold=0.1).plan(_found("search", _ASKED, cardinality="one")))


@query("text_search_reranked", f"""WITH {_hybrid('type: Chunk' + chr(10) + 'text: ' + _ASKED, {'type': 1, 'chunk': 1, 'text': 1} | _TERMS_ASKED, 40)}
SELECT nid AS id, round(cos.score, 6) AS score FROM hyb JOIN cos USING (nid) WHERE cos.score >= 0.2""")  # fmt: skip
def text_search_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_index(spark, sf_dir, reranker_threshold=0.2).plan(_found("search_reranked", _ASKED)))


_LEX = f"WITH {_lexical({'thing': 1, 'the': 1})}, k AS (SELECT * FROM lex ORDER BY round(score, 9) DESC, nid LIMIT 20)"


@query("text_in", f"{_LEX} SELECT nid AS id, round(score, 6) AS score FROM k")
def text_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_index(spark, sf_dir, grounding=True).plan(_found("in", ["thing", "the"])))


@query("text_neq", f"{_LEX} SELECT nid AS id, round(score, 6) AS score FROM k")
def text_neq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_index(spark, sf_dir, grounding=True).plan(_found("neq", "the thing")))


@query("text_lexical_miss", "SELECT doc_id AS id, 0.0::DOUBLE AS score FROM documents WHERE false")
def text_lexical_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, grounding=True).plan(_found("contains", "zzqqxx"))


_FIRST = "(SELECT text FROM documents WHERE text IS NOT NULL AND length(text) BETWEEN 40 AND 400 ORDER BY doc_id LIMIT 1)"


@query("text_exact_on_fallback", f"SELECT min(doc_id) AS id FROM documents WHERE text = {_FIRST}")
def text_exact_on_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _docs(spark, sf_dir).where("length(text) between 40 and 400").orderBy("nid").first()["text"]
    return _index(spark, sf_dir, search_k=400).plan(_found("eq", text, cardinality="many")).agg(F.min("id").alias("id"))


@query("text_two_retrievals", f"""{_LEX}, m AS (SELECT nid FROM lex ORDER BY round(score, 9) DESC, nid LIMIT 20)
SELECT k.nid AS a, d.source AS s, round(k.score, 6) AS score FROM k JOIN documents d ON d.doc_id = k.nid WHERE d.source IS NOT NULL""")  # fmt: skip
def text_two_retrievals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both aliases are pinned by a search each; their scores add up, the source's index has its name as text."""
    e = _index(spark, sf_dir, grounding=True)
    return _scored(e.plan(q(n("Chunk", "d"), [hop("part_of", "Source", "s")], [flt("d.text", "contains", "the thing", "SemanticText")], [ret("d.doc_id", "a"), ret("s.name", "s")])))


@query("text_prefix_index", f"{_LEX} SELECT nid AS id, round(score, 6) AS score FROM k")
def text_prefix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's own collection is searched, not the shared one."""
    e = engine(spark, sf_dir, grounding=True)
    e.indexes["Chunk"] = TextIndex(spark.createDataFrame([(1, "the thing")], "doc_id long, text string"), "doc_id", "text")
    e.indexes[("t1", "Chunk")] = TextIndex.stored(_stored_documents(spark, sf_dir), "docs")
    return _scored(e.plan(_found("contains", "the thing") | {"prefix_index": "t1"}))


@query("explore_semantic_search", f"WITH {_hybrid(_ASKED, _TERMS_ASKED, 50)} SELECT 'Chunk' AS type, CAST(nid AS VARCHAR) AS id, round(score, 6) AS score FROM hyb")
def explore_semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(Explorer(_index(spark, sf_dir)).search(_ASKED, "Chunk").select("type", "id", "score"))


@query("rerank_cosine", f"""WITH {_dense(_ASKED)} SELECT nid, round(greatest(score, 0), 6) AS rerank FROM cos""")
def rerank_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = vector.CosineReranker(vector.HashingEmbedder()).score(_docs(spark, sf_dir), _ASKED)
    return got.select("nid", F.round("rerank", 6).alias("rerank"))


@query("embedder_vectors", rf"""WITH {_embedded("a", "(SELECT item_id AS nid, text FROM benchmark WHERE text IS NOT NULL)")} SELECT nid, CAST(d AS INTEGER) AS place, round(v / n, 6) AS v FROM a_v JOIN a_n USING (nid) WHERE v <> 0""")
def embedder_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _t(spark, sf_dir, "benchmark").where("text is not null")
    each = b.select(F.col("item_id").alias("nid"), F.posexplode(vector.HashingEmbedder().column(F.col("text"))).alias("place", "v"))
    return each.where("v <> 0").withColumn("v", F.round("v", 6))


# --- retrieval over the graph: all columns --------------------------------------

_RAG_ALL = f"""WITH v AS (SELECT vec_id AS nid, label, {_COS} AS s FROM embeddings),
e AS (SELECT nid, s FROM v WHERE label >= 5 ORDER BY s DESC, nid LIMIT 50), c AS (SELECT nid, s FROM v WHERE label < 5 ORDER BY s DESC, nid LIMIT 50),
m AS (SELECT v.nid AS chunk, v.nid + d AS entity FROM v, (SELECT unnest([1, 3]) AS d) WHERE v.label < 5),
a AS (SELECT chunk, sum(s) AS es FROM m JOIN e ON e.nid = m.entity GROUP BY 1),
r AS (SELECT coalesce(a.chunk, c.nid) AS chunk, coalesce(es, 0) + coalesce(s, 0) AS score FROM a FULL JOIN c ON a.chunk = c.nid ORDER BY score DESC, chunk LIMIT 20),
i AS (SELECT chunk, entity FROM m JOIN e ON e.nid = m.entity UNION SELECT m.chunk, entity FROM m JOIN c ON c.nid = m.chunk),
l AS (SELECT chunk, string_agg(entity || ':' || coalesce('T' || v.label, '-') || ':' || coalesce('e' || v.nid, '-'), ' ' ORDER BY entity) AS entities FROM i LEFT JOIN v ON v.nid = entity AND v.label >= 5 GROUP BY 1)
SELECT 'c' || r.chunk AS chunk_id, 'text ' || r.chunk AS chunk_text, r.chunk % 7 AS source_id, 's' || (r.chunk % 7) AS source_name, round(score, 6) AS score, entities FROM r JOIN l USING (chunk)"""


@query("rag_traversal_columns", _RAG_ALL)
def rag_traversal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = retrieve.traversal(_retrieval(spark, sf_dir), TraversalQuery((), "goal", limit=20), _OneVector(_first_vector(spark, sf_dir)))
    shown = F.array_join(F.transform("entities", lambda x: F.concat_ws(":", x["eid"].cast("string"), F.coalesce(x["type"], F.lit("-")), F.coalesce(x["etext"], F.lit("-")))), " ")
    return got.withColumns({"entities": shown, "score": F.round("score", 6)})


_TYPES_ALL = f"""WITH v AS (SELECT vec_id AS nid, label, {_COS} AS s FROM embeddings),
e AS (SELECT nid, 'T' || label AS t, s, '_canonical' AS c FROM v WHERE label >= 5 AND s >= 0.1 ORDER BY s DESC, nid LIMIT 32), k AS (SELECT nid, 'Chunk' AS t, s, 'text' AS c FROM v WHERE label < 5 AND s >= 0.1 ORDER BY s DESC, nid LIMIT 32),
h AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY s DESC, nid) AS r FROM (SELECT * FROM e UNION ALL SELECT * FROM k)),
f AS (SELECT t AS entity_type, round(max(s), 6) AS score, min(c) || '=' || round(max(s), 4) AS collections, string_agg(CASE WHEN r <= 5 THEN CAST(nid AS VARCHAR) END, ' ' ORDER BY r) AS samples, false AS is_neighbor FROM h GROUP BY 1),
m AS (SELECT v.nid AS chunk, v.nid + d AS entity FROM v, (SELECT unnest([1, 3]) AS d) WHERE v.label < 5),
o AS (SELECT DISTINCT 'T' || v.label AS t FROM m JOIN h ON h.nid = m.chunk JOIN v ON v.nid = m.entity AND v.label >= 5 UNION SELECT DISTINCT 'Chunk' FROM m JOIN h ON h.nid = m.entity)
SELECT * FROM f UNION ALL SELECT t, NULL, '', '', true FROM o WHERE t NOT IN (SELECT entity_type FROM f)"""


@query("entity_types_columns", _TYPES_ALL)
def entity_types_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = retrieve.entity_types(_retrieval(spark, sf_dir), EntityTypeQuery("goal", score_threshold=0.1, include_neighbors=True), _OneVector(_first_vector(spark, sf_dir)))
    shown = F.array_join(F.transform(F.map_entries("collections"), lambda x: F.concat(x["key"], F.lit("="), F.round(x["value"], 4).cast("string"))), " ")
    return got.select("entity_type", F.round("score", 6).alias("score"), shown.alias("collections"), F.array_join("samples", " ").alias("samples"), "is_neighbor")


# --- provenance on any alias -----------------------------------------------------


def _traced(spark: SparkSession, sf_dir: str) -> Engine:
    """Nations, regions and segments; the first two are traced to sources by edges of their own, and all ids overlap or are text."""
    t = lambda name: _t(spark, sf_dir, name)
    g = GraphCatalog(spark)
    g.add_node("Nation", t("nation"), "n_nationkey").add_node("Region", t("region"), "r_regionkey")
    g.add_node("Segment", t("customer").select("c_mktsegment").distinct(), "c_mktsegment")
    g.add_node("Source", t("documents").where("source is not null").select(F.col("source").alias("name")).distinct(), "name")
    g.add_edge("IN_REGION", "Nation", "Region", t("nation"), "n_nationkey", "n_regionkey", key="n_nationkey", embedded="source")
    name = F.concat(F.lit("src"), F.col("k") % 3)
    g.add_edge("mention", "Nation", "Source", t("nation").select(F.col("n_nationkey").alias("k")).withColumn("s", name), "k", "s", key="k")
    g.add_edge("mention", "Region", "Source", t("region").select(F.col("r_regionkey").alias("k")).where("k > 0").withColumn("s", name), "k", "s", key="k")
    return Engine(g, Settings(max_limit=None))


@query("sources_any_label", """SELECT 'Nation' AS label, CAST(n_nationkey AS VARCHAR) AS id, 'src' || (n_nationkey % 3) AS sources FROM nation
UNION ALL SELECT 'Region', CAST(r_regionkey AS VARCHAR), CASE WHEN r_regionkey > 0 THEN 'src' || (r_regionkey % 3) ELSE '' END FROM region
UNION ALL SELECT 'Segment', c_mktsegment, '' FROM customer GROUP BY 2 UNION ALL SELECT 'Source', source, '' FROM documents WHERE source IS NOT NULL GROUP BY 2""")  # fmt: skip
def sources_any_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _traced(spark, sf_dir).plan(q(n("", "x"), returns=[ret("x.label", "label"), ret("x.id", "id")]))
    return got.withColumn("sources", F.array_join("sources", " "))


@query("sources_of_all_aliases", """SELECT n_name AS nation, r_name AS region, CASE WHEN r_regionkey = 0 OR r_regionkey % 3 = n_nationkey % 3 THEN 'src' || (n_nationkey % 3)
 ELSE 'src' || least(n_nationkey % 3, r_regionkey % 3) || ' src' || greatest(n_nationkey % 3, r_regionkey % 3) END AS sources FROM nation JOIN region ON n_regionkey = r_regionkey""")  # fmt: skip
def sources_of_all_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _traced(spark, sf_dir).plan(q(n("Nation", "n"), [hop("IN_REGION", "Region", "r")], returns=[ret("n.n_name", "nation"), ret("r.r_name", "region")]))
    return got.withColumn("sources", F.array_join("sources", " "))


@query("implicit_dedup_parallel_edges", "SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity > 40")
def implicit_dedup_parallel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines of one order and part are one row where sources are shown."""
    g = table_graph(spark, sf_dir)
    g.add_edge("mention", "Part", "Source", _t(spark, sf_dir, "part").select("p_partkey", F.lit("src0").alias("s")), "p_partkey", "s", key="p_partkey")
    got = Engine(g, Settings(max_limit=None)).plan(q(n("Order", "o"), [hop("CONTAINS", "Part", "p", edge="l")], [flt("l.l_quantity", "gt", 40)], [ret("o.o_orderkey", "o"), ret("p.p_partkey", "p")]))
    return got.where(F.array_contains("sources", "src0")).select("o", "p")


# --- projections, names, order ----------------------------------------------------

@query("project_date_part_of_text", "SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h FROM orders")
def project_date_part_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
    g = GraphCatalog(spark).add_node("Order", o, "o_orderkey")
    parts = [ret("o.at", p[0], part=p) for p in ("year", "quarter", "month", "day", "hour")]
    return Engine(g, Settings(max_limit=None)).plan(q(n("Order", "o"), returns=[ret("o.o_orderkey", "id"), *parts]))


@query("iso_epochs", "SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) AS epoch, CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) AS day FROM orders WHERE o_orderdate IS NOT NULL")
def iso_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").where("o_orderdate is not null")
    long, short = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(F.col("o_orderkey").alias("id"), scalars.iso_epoch(long).alias("epoch"), scalars.iso_epoch(short).alias("day"))


@query("project_whole_node", """SELECT '{"nid":' || n_nationkey || ',"label":"Nation","n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS n FROM nation""")
def project_whole_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).plan(q(n("Nation", "n"), returns=[ret("n")])).select(F.to_json("n").alias("n"))


@query("default_names", 'SELECT o_orderstatus AS "o.o_orderstatus", CAST(year(o_orderdate) AS INTEGER) AS "o_o_orderdate_year", count(*) AS "count(o)", sum(o_totalprice) AS "sum(o.o_totalprice)", min(o_totalprice) AS "min(o.o_totalprice)" FROM orders GROUP BY 1, 2')
def default_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = [ret("o.o_orderstatus"), ret("o.o_orderdate", part="year"), ret("o", agg="count"), ret("o.o_totalprice", agg="sum"), ret("o.o_totalprice", agg="min")]
    return engine(spark, sf_dir).plan(q(n("Order", "o"), returns=returns, group_by=["o.o_orderstatus", {"field": "o.o_orderdate", "date_part": "year"}]))


@query("score_breaks_ties", f"{_LEX} SELECT nid AS id, lang, round(score, 6) AS score FROM k JOIN documents ON doc_id = nid ORDER BY lang NULLS LAST, k.score DESC LIMIT 7")
def score_breaks_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _index(spark, sf_dir, grounding=True)
    return _scored(e.plan(_found("contains", "the thing", returns=[ret("d.doc_id", "id"), ret("d.lang", "lang")]) | {"sort": [{"field": "lang"}], "limit": 7}))


@query("sort_on_list_is_dropped", "SELECT vec_id AS id FROM embeddings ORDER BY vec_id DESC LIMIT 9")
def sort_on_list_is_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).plan(q(n("Vec", "v"), returns=[ret("v.vec_id", "id")], sort=[{"field": "v.embedding"}, {"field": "id", "order": "desc"}], limit=9))


@query("filter_context_and_hidden_ids", """SELECT c_name AS "c.c_name", o_orderkey AS "o.o_orderkey", o_orderstatus AS "o.o_orderstatus" FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_totalprice > 100000""")
def filter_context_and_hidden_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible table: plain filters' fields are shown, ids are not."""
    d = q(CUST, [PLACED], [flt("o.o_orderstatus", "eq", "F"), flt("o.o_totalprice", "gt", 100000, "Number")], [ret("c.c_name"), ret("o.o_orderkey")])
    return _explorer(spark, sf_dir).run_query(d)["table"]


@query("nodes_behind_a_table", """SELECT 'Customer' AS type, CAST(c_custkey AS VARCHAR) AS nid FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 150000 GROUP BY 2
UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000""")  # fmt: skip
def nodes_behind_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explorer(spark, sf_dir).run_query(q(CUST, [PLACED], [flt("o.o_totalprice", "gt", 150000)], [ret("c.c_name")]))["nodes"]


_OWNERS = [("c.c_name", "c"), ("total", "o"), ("o.o_orderstatus", "o")]


@query("column_owners", _values(_OWNERS, "name", "alias"))
def column_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = q(CUST, [PLACED], [flt("o.o_orderstatus", "eq", "F")], [ret("c.c_name"), ret("o.o_totalprice", "total")])
    return _rows(spark, "name string, alias string", list(_explorer(spark, sf_dir).run_query(d)["owners"].items()))


# --- the explorer's whole results ---------------------------------------------------


@query("explore_entity_whole", """SELECT CAST(c_custkey AS VARCHAR) AS id, 'Customer' AS type, c_name AS name,
 'BY_USER in Event ' || (SELECT count(*) FROM events WHERE user_id = c_custkey) || ', FROM_NATION out Nation 1, PLACED out Order ' || (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS relations,
 '' AS sources, c_custkey || ' ' || c_nationkey || ' ' || c_mktsegment AS props FROM customer WHERE c_custkey = 7""")  # fmt: skip
def explore_entity_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = _explorer(spark, sf_dir).entity("7", "Customer")
    relations = F.array_join(F.transform("relations", lambda r: F.concat_ws(" ", r["rel"], r["direction"], r["other_type"], r["count"].cast("string"))), ", ")
    prop = lambda p: F.get_json_object("props", f"$.{p}")
    return card.select("id", "type", "name", relations.alias("relations"), F.array_join("sources", " ").alias("sources"), F.concat_ws(" ", prop("c_custkey"), prop("c_nationkey"), prop("c_mktsegment")).alias("props"))


@query("explore_entity_sources", "SELECT CAST(doc_id AS VARCHAR) AS id, 'Chunk' AS type, source AS sources FROM documents WHERE source IS NOT NULL ORDER BY doc_id LIMIT 1")
def explore_entity_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _t(spark, sf_dir, "documents").where("source is not null").agg(F.min("doc_id")).first()[0]
    return _explorer(spark, sf_dir).entity(first, "Chunk").select("id", "type", F.array_join("sources", " ").alias("sources"))


@query("explore_neighbors_page", """SELECT rel, direction, type, id FROM (SELECT 'PLACED' AS rel, 'out' AS direction, 'Order' AS type, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey = 7) ORDER BY rel, id LIMIT 5 OFFSET 3""")
def explore_neighbors_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explorer(spark, sf_dir).neighbors("7", "Customer", rels=["PLACED"], target="Order", direction="out", limit=5, offset=3).select("rel", "direction", "type", "id")


@query("explore_subgraph_nodes", "SELECT 'Nation' AS type, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation ORDER BY n_name LIMIT 12")
def explore_subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explorer(spark, sf_dir).subgraph_of_type("Nation", 12)[0].select("type", "id", "name")


@query("explore_sources", "SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL ORDER BY 1 LIMIT 200")
def explore_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explorer(spark, sf_dir).sources()


_BUCKETS = [("r_name", "identifiers"), ("r_regionkey", "facts"), ("r_note", "descriptions"), ("r_day", "dates"), ("r_tags", "identifiers"), ("r_ok", "facts"), ("other", "other"), ("_hidden", None)]


@query("property_buckets", _values(_BUCKETS, "property", "bucket"))
def property_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"r_name": "keyword", "r_note": "text", "r_day": "datetime", "r_tags": "list", "r_ok": "bool"}
    o = onto.Ontology.of({"geo": {"entity_types": [{"name": "Region", "properties": [{"name": p, "property_type": k} for p, k in kinds.items()]}]}})
    schema = _rows(spark, "r_name string, r_regionkey int, r_note string, r_day string, r_tags array<string>, r_ok boolean, other string, _hidden string", []).schema
    return _rows(spark, "property string, bucket string", [(f.name, bucket_of(o, "Region", f.name, f.dataType)) for f in schema])


# --- validation: what is refused, and how ---------------------------------------------

_GOOD = q(n("Customer", "c"), returns=[ret("c.c_name")])
_BAD = [
    ("alias twice", q(n("Customer", "c"), [hop("PLACED", "Order", "c")], returns=[ret("c.c_name")]), "QueryError"),
    ("alias is no identifier", q(n("Customer", "c d"), returns=[ret("c.c_name")]), "QueryError"),
    ("label is no identifier", q(n("Customer`", "c"), returns=[ret("c.c_name")]), "QueryError"),
    ("malformed operator", q(CUST, filters=[flt("c.c_name", "eq; drop", 1)], returns=[ret("c.c_name")]), "QueryError"),
    ("unknown operator", q(CUST, filters=[flt("c.c_name", "resembles", 1)], returns=[ret("c.c_name")]), "LoweringError"),
    ("unknown alias", q(CUST, filters=[flt("x.c_name", "eq", 1)], returns=[ret("c.c_name")]), "LoweringError"),
    ("unknown source of a hop", q(CUST, [hop("PLACED", "Order", "o", "z")], returns=[ret("o.o_orderkey")]), "LoweringError"),
    ("nothing returned", q(CUST), "QueryError"), ("three parts in a field", q(CUST, returns=[ret("c.a.b")]), "QueryError"),
    ("limit of nothing", q(CUST, returns=[ret("c.c_name")], limit=0), "QueryError"), ("depth upside down", q(n("Turn", "a"), [hop("NEXT_TURN", "Turn", "b", depth=(3, 2))], returns=[ret("b.turn_id")]), "QueryError"),
    ("depth over the limit", q(n("Turn", "a"), [hop("NEXT_TURN", "Turn", "b", depth=(1, 7))], returns=[ret("b.turn_id")]), "LoweringError"),
    ("plain beside aggregate", q(CUST, returns=[ret("c.c_name"), ret("c", agg="count")]), "LoweringError"),
    ("sort of distinct by what is not returned", q(CUST, returns=[ret("c.c_name")], distinct=True, sort=[{"field": "c.c_custkey"}]), "LoweringError"),
    ("typed operator of another type", q(CUST, filters=[flt("c.c_name", "matches", "x", "Timestamp")], returns=[ret("c.c_name")]), "FieldTypeError"),
    ("no text index", q(CUST, filters=[flt("c.c_name", "search", "x", "SemanticText")], returns=[ret("c.c_name")]), "LoweringError"),
    ("unknown label", q(n("Nobody", "c"), returns=[ret("c.c_name")]), "LoweringError"), ("well formed", _GOOD, "accepted"),
]


@query("refused_documents", _values([(name, kind) for name, _, kind in _BAD], "name", "outcome"))
def refused_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, out = engine(spark, sf_dir), []
    for name, d, _ in _BAD:
        try:
            e.plan(d)
            out.append((name, "accepted"))
        except GraphError as x:
            out.append((name, type(x).__name__))
    return _rows(spark, "name string, outcome string", out)


# --- graph documents, keys and resolution --------------------------------------------

_SITE = {
    "source": "plan",
    "entities": [
        {"id": "hall", "type": "Place", "primary_key": {"strict": "id"}, "name": {"type": "Keyword", "value": "Hall"}, "opened": {"type": "date", "value": "2020-01-05"}},
        {"id": "s1", "type": "Sensor", "primary_key": {"strict": "id"}, "tags": {"type": "List", "value": ["Door", "Heat"]}, "volts": {"type": "Number", "value": "1,200"}, "on": {"type": "Bool", "value": "yes"}},
        {"id": "soft", "type": "Note", "name": {"type": "Text", "value": "Soft one"}},
        {"id": "c1", "type": "Chunk", "chunk_id": {"type": "Keyword", "value": "c1"}, "text": "The hall is hot."},
    ],
    "relations": [{"from": "s1", "to": "hall", "type": "IN", "since": {"type": "Number", "value": "2021"}}],
}
_LOWERED = [
    ("hall", "id", "hall", "name", '"Hall"'), ("hall", "id", "hall", "id", '"hall"'), ("s1", "id", "s1", "volts", "1200"), ("s1", "id", "s1", "on", "true"), ("s1", "id", "s1", "id", '"s1"'),
    ("soft", "_canonical", "type: Note\nname: Soft one", "name", '"Soft one"'), ("c1", "id", "c1", "text", '"The hall is hot."'), ("c1", "id", "c1", "chunk_id", '"c1"'),
]


@query("graph_json_lowering", _values([(a, b, c.replace("\n", "/"), d, e) for a, b, c, d, e in _LOWERED], "id", "key_field", "key", "property", "value"))
def graph_json_lowering(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, _ = to_frames(spark, parse_graph(_SITE))
    each = entities.where("type <> 'Source'").select(F.col("local_id").alias("id"), "key_field", F.replace("key", F.lit("\n"), F.lit("/")).alias("key"), F.explode("props").alias("property", "value"))
    return each.where("property in ('name', 'volts', 'on', 'text', 'chunk_id') or property = 'id' and id in ('hall', 's1')")


_RELS = [("IN", "s1", "hall", "2021"), ("mention", "hall", "plan", None), ("mention", "s1", "plan", None), ("mention", "soft", "plan", None), ("part_of", "c1", "plan", None)]


@query("graph_json_relations", _values(_RELS, "rel", "a", "b", "since"))
def graph_json_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, relations = to_frames(spark, parse_graph(_SITE))
    source = entities.where("type = 'Source'").first()["local_id"]
    end = lambda c: F.when(F.col(c) == source, "plan").otherwise(F.col(c))
    return relations.select("rel", end("from_id").alias("a"), end("to_id").alias("b"), F.col("props")["since"].alias("since"))


def _built(spark: SparkSession, sf_dir: str) -> GraphStore:
    """Regions and nations through the builder, stored."""
    b = GraphBuilder(scope="table").source("geo")
    regions, nations = _t(spark, sf_dir, "region").collect(), _t(spark, sf_dir, "nation").collect()  # 5 and 25 rows
    for r in regions:
        b.entity(f"r{r['r_regionkey']}", "Region", {"name": r["r_name"]}, strict="id")
    for r in nations:
        b.entity(f"n{r['n_nationkey']}", "Nation", {"name": r["n_name"]}, strict="id")
        b.relationship(f"n{r['n_nationkey']}", "IN", f"r{r['n_regionkey']}", {"key": r["n_nationkey"]})
    folder = _folder(spark, "graph")
    s = GraphStore(spark, f"{folder}/graph", vectors=VectorStore(spark, f"{folder}/vectors"))
    s.summary = s.ingest(b.build())
    return s


@query("builder_round_trip", "SELECT n_name AS nation, r_name AS region, n_nationkey AS key FROM nation JOIN region ON n_regionkey = r_regionkey")
def builder_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(_built(spark, sf_dir).catalog(), Settings(max_limit=None, auto_sources=False))
    got = e.plan(q(n("Nation", "n"), [hop("IN", "Region", "r", edge="i")], returns=[ret("n.name", "nation"), ret("r.name", "region"), ret("i.key", "key")]))
    return got.withColumn("key", F.col("key").cast("int"))


@query("ingest_summary", "SELECT 1 + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS nodes, 2 * (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS edges, 0 AS new_nodes_again")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _built(spark, sf_dir)
    again = s.ingest(GraphBuilder().entity("n1", "Nation", {"name": "other"}, strict="id").build())
    return _rows(spark, "nodes long, edges long, new_nodes_again int", [(s.summary.nodes, s.summary.edges, again.new_nodes)])


@query("ingest_vectors", """SELECT 'Nation' AS label, 'type: Nation' || chr(10) || 'name: ' || n_name AS text, 1.0::DOUBLE AS length FROM nation UNION ALL SELECT 'Region', 'type: Region' || chr(10) || 'name: ' || r_name, 1.0 FROM region
UNION ALL SELECT 'Source', 'type: Source', 1.0""")  # fmt: skip
def ingest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ingest has embedded: the canonical text of every node."""
    got = _built(spark, sf_dir).vectors.read("_canonical")
    return got.select("label", "text", F.round(scalars.norm(F.col("vec")), 6).alias("length"))


@query("export_subgraph", "SELECT 'n' || n_nationkey AS id, n_name AS name, 'r' || n_regionkey AS region FROM nation")
def export_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _built(spark, sf_dir)
    out = s.export(s.nodes().where("type in ('Nation', 'Region')").select("nid"))
    names = {e["id"]: (e["properties"]["id"]["value"], e["properties"]["name"]["value"]) for e in out["entities"]}
    return _rows(spark, "id string, name string, region string", [(*names[r["from"]], names[r["to"]][0]) for r in out["relations"]])


@query("delete_sweeps_vectors", _values([("Nation", 1)], "label", "n"))
def delete_sweeps_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation that another source mentions too stays, with its vector; all that one source alone brought goes."""
    s = _built(spark, sf_dir)
    s.ingest(GraphBuilder(scope="table").source("other").entity("n3", "Nation", {}, strict="id").build())
    s.delete_by_source("geo")
    left = s.vectors.read("_canonical").where("label <> 'Source'")
    return left.groupBy("label").agg(F.count("*").cast("int").alias("n"))


_C = "type: P\nname: Ann Smith"
_HITS = [
    (1, _C, {}, 10, _C, {}, 0.99), (2, _C, {}, 10, _C, {}, 0.955), (3, _C, {}, 10, _C, {}, 0.99), (3, _C, {}, 11, _C, {}, 0.97), (4, _C, {}, 10, "type: P\nname: Zzqx", {}, 0.99),
    (5, _C, {}, 10, _C, {}, 0.99), (5, _C, {}, 11, _C, {}, 0.975), (5, _C, {}, 12, _C, {}, 0.97), (6, _C, {"email": '"a"'}, 10, _C, {"email": '"b"'}, 0.99), (7, "type: P", {}, 10, "type: P", {}, 0.99),
    (8, _C, {}, 10, _C, {}, 0.5), (9, _C, {"email": '""'}, 10, _C, {"email": '"b"'}, 0.99), (10, _C, {"id": '"1"'}, 10, _C, {"id": '"2"'}, 0.8),
]
_DECIDED = [
    (1, "merge", ""), (2, "review", "below_auto_merge_threshold"), (3, "review", "insufficient_margin"), (4, "review", "insufficient_lexical"), (5, "review", "insufficient_margin too_many_close_candidates"),
    (6, "review", "hard_conflict"), (7, "review", "insufficient_lexical type_only"), (8, "none", "below_auto_merge_threshold"), (9, "merge", ""), (10, "review", "below_auto_merge_threshold hard_conflict"),
]


@query("all_merge_gates", _values(_DECIDED, "idx", "outcome", "reasons"))
def all_merge_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gate by itself, two at once, under the review band, and an empty value that is no conflict."""
    hits = _rows(spark, "idx int, canonical string, props map<string,string>, hit long, hit_canonical string, hit_props map<string,string>, score double", _HITS)
    return resolve.gates(hits, resolve.ResolveConfig()).select("idx", "outcome", F.array_join("reasons", " ").alias("reasons"))


class _Bearing:
    """An embedder that places a text at the angle, in degrees, that its last word is."""

    dim = 2

    def embed(self, texts):
        import numpy as np

        a = np.radians([float(t.rsplit(" ", 1)[1]) for t in texts])
        return np.stack([np.cos(a), np.sin(a)], 1)

    def column(self, c):
        a = F.radians(F.regexp_extract(c, r"(-?\d+)$", 1).cast("double"))
        return F.array(F.cos(a), F.sin(a))


_PEOPLE = [("collapsed", 1), ("merged", 1), ("nodes", 3), ("reviewed", 1)]


@query("soft_merge_outcomes", _values(_PEOPLE, "what", "n"))
def soft_merge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft entities that merge in their batch, with what is stored, or come near enough to be reviewed."""
    person = lambda i, at: {"id": f"{i}", "type": "Person", "name": {"type": "Text", "value": f"Ann Smith {at}"}}
    r = resolve.Resolver(_Bearing(), resolve.ResolveConfig(conflict_properties=("email",)))
    s = GraphStore(spark, _folder(spark, "graph"))
    a = s.ingest(parse_graph({"entities": [person(1, 0), person(2, 5), person(3, 90)]}), r)
    b = s.ingest(parse_graph({"entities": [person(4, 92), person(5, 17)]}), r)
    got = [("collapsed", a.merges["collapsed_in_batch"]), ("merged", b.merges["merged_with_stored"]), ("nodes", s.nodes().count()), ("reviewed", b.merges["reviews"].count())]
    return _rows(spark, "what string, n int", got)


# --- schema, ontology, language -----------------------------------------------------

_CLASSED = [
    ("x t1 scope_table y", "x", "y", "table"), ("people Zed", "Zed", "people", ""), ("Person scope_text scope_table", "Person", "people", "table text"), ("scope_text", None, None, "text"), ("people Person", "Person", "people", ""),
]


@query("label_classification", _values(_CLASSED, "labels", "type", "domain", "scopes"))
def label_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = onto.Ontology.of({"people": {"entity_types": [{"name": "Person"}]}})
    got = [(x, *retrieve.classify(x.split(), o, "t1")) for x, *_ in _CLASSED]
    return _rows(spark, "labels string, type string, domain string, scopes string", [(x, t, d, " ".join(s)) for x, t, d, s in got])


_ROUTED = [("bread and cheese", "food"), ("engines of cars", "cars"), ("zzz qqq", None)]


@query("domain_routing", _values(_ROUTED, "question", "domain"))
def domain_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = onto.Ontology.of({"cars": {"description": "cars engines"}, "food": {"description": "bread cheese"}})
    e = vector.HashingEmbedder(256)
    found = [(x, o.route(x, e, 1)) for x, _ in _ROUTED]
    return _rows(spark, "question string, domain string", [(x, r[0][0] if r else None) for x, r in found])


@query("schema_filter", _values([("BenchmarkItem",), ("Nation",), ("Region",)], "label"))
def schema_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = introspect.introspect(table_graph(spark, sf_dir))
    kept = {k.label for part in ("NATIO", "benchmark", "egio") for k in s.filtered(part).nodes}
    return _rows(spark, "label string", [(x,) for x in sorted(kept)])


@query("schema_projection", _values([("Order", "o_orderstatus", "f o p x")], "label", "property", "allowed"))
def schema_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live schema seen through a domain: its types and properties only, its values beside those found."""
    s = introspect.introspect(table_graph(spark, sf_dir))
    d = onto.Domain.of({"entity_types": [{"name": "Order", "properties": [{"name": "o_orderstatus", "allowed_values": ["X"]}]}]})
    # sources and chunks are seen through every domain
    rows = [(k.label, p.name, " ".join(p.values)) for k in introspect.project(s, [d]).nodes if k.label not in (CHUNK, SOURCE) for p in k.properties]
    return _rows(spark, "label string, property string, allowed string", rows)


_VERSIONS = [("created", "1"), ("patched", "2"), ("stale", "VersionConflict"), ("twice", "GraphError"), ("properties", "x:Number y:Keyword"), ("renamed", "two"), ("collected", "B"), ("read only", "Unsupported")]


class _Kept:
    """Ontology storage in memory."""

    def __init__(self):
        self.doc: dict = {}

    def load(self) -> dict:
        return json.loads(json.dumps(self.doc))

    def save(self, doc: dict) -> None:
        self.doc = doc


@query("ontology_versions", _values(_VERSIONS, "step", "result"))
def ontology_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = onto.OntologyService(_Kept())
    d = {"entity_types": [{"name": "A", "properties": [{"name": "x", "property_type": "int"}]}]}
    out = [("created", str(s.create("one", d))), ("patched", str(s.patch("one", {"entity_types": [{"name": "A", "properties": [{"name": "x", "property_type": "text"}, {"name": "y"}]}, {"name": "B"}]}, version=1)))]

    def refused(f) -> str:
        try:
            f()
        except GraphError as e:
            return type(e).__name__
        return "accepted"

    out += [("stale", refused(lambda: s.replace("one", d, version=1))), ("twice", refused(lambda: s.create("one", d)))]
    out.append(("properties", " ".join(f"{p.name}:{p.type}" for p in s.get("one")[0].entity("A").properties)))
    s.rename("one", "two")
    out.append(("renamed", " ".join(s.names())))
    s.refresh(onto.Ontology.of({"two": {"entity_types": [{"name": "B"}]}}), collect_garbage=True)
    out.append(("collected", " ".join(t.name for t in s.get("two")[0].entity_types)))
    out.append(("read only", refused(lambda: onto.OntologyService(onto.ReadOnlyStorage({})).create("x", d))))
    return _rows(spark, "step string, result string", out)


@query("question_to_table", "SELECT r_name AS \"r.r_name\" FROM region WHERE r_name = 'ASIA'")
def question_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question through a model whose first answer must be repaired."""
    answers = iter(['{"start": {"label": "Region"}}', json.dumps(q(n("Region", "r"), filters=[flt("r.r_name", "eq", "ASIA")], returns=[ret("r.r_name")]))])

    schema = introspect.introspect(table_graph(spark, sf_dir).part("Region", "Nation"))
    got = language.question_to_query("the region Asia?", schema, lambda messages: next(answers))
    return engine(spark, sf_dir).plan(got.query)


_DESCRIBED = q(CUST, [PLACED], [flt("o.o_orderstatus", "eq", "F")], [ret("c.c_name", "name"), ret("o", "n", "count")], group_by=["c.c_name"])


@query("describe_round_trip", "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1")
def describe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document parsed, described and run; its description names every part."""
    parsed = dsl.parse(json.dumps(_DESCRIBED))
    text = json.dumps(parsed.describe()) if not isinstance(parsed.describe(), str) else parsed.describe()
    if not all(part in text for part in ("Customer", "PLACED", "Order", "o_orderstatus", "c_name")):
        raise GraphError(f"the description lacks a part: {text}")
    return engine(spark, sf_dir).plan(parsed)
