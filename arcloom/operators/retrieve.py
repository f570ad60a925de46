"""Retrieval over the graph: ranked chunks for a goal and entities, and the entity types a text is about."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dsl import EntityTypeQuery, TraversalQuery
from ..sources.catalog import CHUNK, SOURCE
from ..sources.graph_json import CANONICAL
from ..sources.ontology import Ontology
from ..sources.vectors import collection
from .ingest import GraphStore, json_text
from .vector import Embedder, Reranker, knn_batch

DEFAULT_LIMIT = 100
MIN_POOL = 50
MAX_SAMPLES = 5
SCOPE_PREFIX = "scope_"


@dataclass
class RetrievalGraph:
    """The tables that retrieval reads.

    entities (nid, type, labels, text, vec), chunks (nid, chunk_id, text, vec),
    mentions (chunk, entity), part_of (chunk, source), sources (nid, name).
    """

    entities: DataFrame
    chunks: DataFrame
    mentions: DataFrame
    part_of: DataFrame
    sources: DataFrame


def _queries(df: DataFrame, texts: Sequence[str], embedder: Embedder) -> DataFrame:
    vecs = embedder.embed(list(texts))
    return df.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "qid long, qvec array<double>")


def traversal(g: RetrievalGraph, q: TraversalQuery, embedder: Embedder, reranker: Reranker | None = None, rerank_threshold: float = 0.0) -> DataFrame:
    """(chunk_id, chunk_text, source_id, source_name, score, [rerank_score], entities), best first.

    Both channels search for every text: entities by their canonical text, and
    chunks by theirs; a node keeps its best score. A chunk scores the sum of the
    entities it mentions that were hit, each once, and its own hit once.
    """
    limit = q.limit or DEFAULT_LIMIT
    k = max(MIN_POOL, 2 * limit)
    texts = q.search_texts()
    asked = _queries(g.chunks, texts, embedder)
    entities = g.entities
    if q.entity_types is not None:
        entities = entities.where(F.arrays_overlap("labels", F.array(*[F.lit(t) for t in q.entity_types])) if q.entity_types else F.lit(False))
    if q.prefix_label:
        entities = entities.where(F.array_contains("labels", q.prefix_label))
    best = lambda df: knn_batch(asked, df.select("nid", "vec"), k).groupBy("nid").agg(F.max("score").alias("hit"))
    entity_hits, chunk_hits = best(entities), best(g.chunks)
    leg = g.mentions.join(entity_hits.withColumnRenamed("nid", "entity"), "entity").select("chunk", "entity", "hit").dropDuplicates(["chunk", "entity"])
    by_entity = leg.groupBy("chunk").agg(F.sum("hit").alias("e_score"), F.collect_set("entity").alias("e_list"))
    around = chunk_hits.withColumnRenamed("nid", "chunk").join(g.mentions, "chunk", "left")
    by_chunk = around.groupBy("chunk").agg(F.max("hit").alias("c_score"), F.collect_set("entity").alias("c_list"))
    both = by_entity.join(by_chunk, "chunk", "full_outer")
    none = F.array().cast(both.schema["e_list"].dataType)
    score = F.coalesce("e_score", F.lit(0.0)) + F.coalesce("c_score", F.lit(0.0))
    merged = both.select("chunk", score.alias("score"), F.array_sort(F.array_union(F.coalesce("e_list", none), F.coalesce("c_list", none))).alias("ids"))
    pool = max(limit, MIN_POOL) if q.rerank and reranker is not None else limit
    top = merged.join(g.chunks.select(F.col("nid").alias("chunk")), "chunk", "left_semi").orderBy(F.desc("score"), "chunk").limit(pool)
    named = (
        top.select("*", F.explode_outer("ids").alias("eid")).join(g.entities.select(F.col("nid").alias("eid"), "type", F.col("text").alias("etext")), "eid", "left")
        .groupBy("chunk").agg(F.first("score").alias("score"), F.array_sort(F.collect_list(F.when(F.col("eid").isNotNull(), F.struct("eid", "type", "etext")))).alias("entities"))
    )
    source = g.part_of.join(g.sources.select(F.col("nid").alias("source"), "name"), "source").groupBy("chunk").agg(F.min(F.struct("source", "name")).alias("s"))
    rows = named.join(g.chunks.select(F.col("nid").alias("chunk"), "chunk_id", "text"), "chunk").join(source, "chunk", "left")
    out = rows.select(
        "chunk", "chunk_id", F.col("text").alias("chunk_text"), F.col("s.source").alias("source_id"), F.col("s.name").alias("source_name"), "score", "entities"
    )
    if q.rerank and reranker is not None:
        scored = reranker.score(out.withColumn("text", F.col("chunk_text")), texts[0]).drop("text").withColumnRenamed("rerank", "rerank_score")
        out = scored.where(F.col("rerank_score") >= rerank_threshold).orderBy(F.desc("rerank_score"), F.desc("score"), "chunk").limit(limit)
        return out.select("chunk_id", "chunk_text", "source_id", "source_name", "score", "rerank_score", "entities")
    return out.orderBy(F.desc("score"), "chunk").drop("chunk")


def classify(labels: Sequence[str], ontology: Ontology | None = None, prefix: str | None = None) -> tuple[str | None, str | None, list[str]]:
    """(entity type, domain, scopes) of a node's labels.

    The tenant's label is dropped and scopes are set apart; a type that the
    ontology knows wins, then a pair of which one is a known domain, then the
    order of the labels.
    """
    rest = [x for x in labels if x != prefix]
    scopes = sorted(x[len(SCOPE_PREFIX):] for x in rest if x.startswith(SCOPE_PREFIX))
    rest = [x for x in rest if not x.startswith(SCOPE_PREFIX)]
    if ontology is not None:
        for x in rest:
            found = ontology.entity(x)
            if found:
                return x, found[0], scopes
        if len(rest) == 2:
            for domain, other in (rest, rest[::-1]):
                if domain in ontology.domains:
                    return other, domain, scopes
    return (rest[0] if rest else None), (rest[1] if len(rest) > 1 else None), scopes


def entity_types(g: RetrievalGraph, q: EntityTypeQuery, embedder: Embedder, ontology: Ontology | None = None, prefix: str | None = None, catalog_signal: bool = False) -> DataFrame:
    """(entity_type, domain, scopes, score, collections, samples, is_neighbor) of the types nearest to a text, best first.

    Searches canonical texts and chunk texts alike; a type has its best node's
    score. Neighbours are types one edge away, without a score. The catalog
    channel, if asked for, adds types whose description is near.
    """
    spark = g.entities.sparkSession
    asked = _queries(g.entities, [q.text], embedder)
    legs = [("_canonical", g.entities.select("nid", "labels", "vec")), ("text", g.chunks.select("nid", F.array(F.lit(CHUNK)).alias("labels"), "vec"))]
    frames = []
    for name, df in legs:
        if q.collections is None or name in q.collections:
            hits = knn_batch(asked, df.select("nid", "vec"), q.top_k, q.score_threshold).drop("qid")
            frames.append(hits.join(df.select("nid", "labels"), "nid").withColumn("collection", F.lit(name)))
    schema = "entity_type string, domain string, scopes array<string>, score double, collections map<string,double>, samples array<long>, is_neighbor boolean"
    if not frames:
        return spark.createDataFrame([], schema)
    hits = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    # label sets are few: they are classified on the driver and joined back
    sets = [list(r["labels"]) for r in hits.select("labels").distinct().collect()]
    table = spark.createDataFrame([(s, *classify(s, ontology, prefix)) for s in sets], "labels array<string>, entity_type string, domain string, scopes array<string>")
    named = hits.join(F.broadcast(table), "labels").where("entity_type is not null")
    order = Window.partitionBy("entity_type").orderBy(F.desc("score"), "nid")
    ranked = named.withColumn("r", F.row_number().over(order))
    per = named.groupBy("entity_type", "collection").agg(F.max("score").alias("s")).groupBy("entity_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("collection", "s")))).alias("collections"))
    rolled = ranked.groupBy("entity_type").agg(
        F.min("domain").alias("domain"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("scopes")))).alias("scopes"), F.max("score").alias("score"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= MAX_SAMPLES, F.struct("r", "nid")))), lambda x: x["nid"].cast("long")).alias("samples"),
    )
    out = rolled.join(per, "entity_type").select("entity_type", "domain", "scopes", "score", "collections", "samples", F.lit(False).alias("is_neighbor"))
    if q.include_neighbors:
        near = neighbor_types(g, ranked.select("nid"), ontology, prefix).join(out.select("entity_type"), "entity_type", "left_anti")
        empty = F.array().cast("array<string>")
        out = out.unionByName(
            near.select(
                "entity_type", F.lit(None).cast("string").alias("domain"), empty.alias("scopes"), F.lit(None).cast("double").alias("score"),
                F.create_map().cast("map<string,double>").alias("collections"), F.array().cast("array<long>").alias("samples"), F.lit(True).alias("is_neighbor"),
            )
        )
    if catalog_signal and q.include_catalog_signal and ontology is not None:
        names = [(t.name, f"{t.name}: {t.description}", d) for d in sorted(ontology.domains) for t in ontology.domains[d].entity_types]
        if names:
            v = embedder.embed([q.text, *[text for _, text, _ in names]])
            scores = v[1:] @ v[0]
            rows = [(n, d, [], float(s), {"catalog": float(s)}, [], False) for (n, _, d), s in zip(names, scores) if s >= q.catalog_threshold]
            extra = spark.createDataFrame(rows, schema).join(out.select("entity_type"), "entity_type", "left_anti")
            out = out.unionByName(extra)
    return out.orderBy(F.desc_nulls_last("score"), "entity_type")


def neighbor_types(g: RetrievalGraph, nids: DataFrame, ontology: Ontology | None, prefix: str | None) -> DataFrame:
    """Types one mention away from any of the nodes."""
    ids = nids.distinct()
    there = g.mentions.join(ids.select(F.col("nid").alias("chunk")), "chunk", "left_semi").select(F.col("entity").alias("nid"))
    types = g.entities.join(there, "nid", "left_semi").select(F.col("type").alias("entity_type"))
    back = g.mentions.join(ids.select(F.col("nid").alias("entity")), "entity", "left_semi").select(F.lit(CHUNK).alias("entity_type"))
    return types.union(back).distinct()


def retrieval_graph(store: GraphStore, embedder: Embedder) -> RetrievalGraph:
    """The retrieval tables of a stored graph, with the vectors that ingest has stored; without a vector store texts are embedded where they are read."""
    nodes, edges = store.nodes(), store.edges()
    prop = lambda name: json_text(F.col("props")[name])
    ents = nodes.where(~F.col("type").isin(SOURCE, CHUNK)).select("nid", "type", "labels", prop(CANONICAL).alias("text")).where("text is not null")
    chunks = nodes.where(F.col("type") == CHUNK).select("nid", F.coalesce(prop("chunk_id"), prop("id")).alias("chunk_id"), prop("text").alias("text")).where("text is not null")

    def with_vectors(df: DataFrame, field: str) -> DataFrame:
        if store.vectors is None:
            return df.withColumn("vec", embedder.column(F.col("text")))
        return df.join(store.vectors.read(collection(field, "", store.prefix_index)).select("nid", "vec"), "nid", "left")

    return RetrievalGraph(
        with_vectors(ents, CANONICAL),
        with_vectors(chunks, "text"),
        edges.where("rel = 'mentions'").select(F.col("src").alias("chunk"), F.col("dst").alias("entity")),
        edges.where("rel = 'part_of'").select(F.col("src").alias("chunk"), F.col("dst").alias("source")),
        nodes.where(F.col("type") == SOURCE).select("nid", prop("name").alias("name")),
    )
