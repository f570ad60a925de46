"""Embedding in tasks: by slices, once a search, and only texts that are asked for."""

import numpy as np
from pyspark.sql import functions as F

from arcloom.operators import vector
from arcloom.plans.dsl import Settings
from arcloom.plans.text import TextIndex, TextPredicate


def test_slices_hold_few_characters_and_all_texts():
    texts = ["x" * 90_000] * 7 + [None, "", "y" * 400_000, "a"]
    parts = list(vector._slices(texts))
    assert [t for p in parts for t in p] == [t or "" for t in texts]
    assert len(parts) > 3 and all(len(p) == 1 or sum(map(len, p)) <= vector.SLICE for p in parts)


def test_cosine_in_tasks_is_that_of_the_vectors(spark):
    e = vector.HashingEmbedder(16)
    texts = ["the cat", "The CAT the cat", "dog", "", None, "!?", "naïve Ünïcode 7_x"] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "nid long, text string")
    q = e.embed(["the naïve cat"])[0]
    got = {r["nid"]: (r["s"], r["v"]) for r in df.select("nid", vector.likeness(e, F.col("text"), q).alias("s"), e.column(F.col("text")).alias("v")).collect()}
    want = e.embed(texts)
    for i in range(len(texts)):
        assert abs(got[i][0] - want[i] @ q) < 1e-12 and np.array_equal(got[i][1], want[i])


def _counted(spark):
    seen = spark.sparkContext.accumulator(0)

    class Counting(vector.HashingEmbedder):
        def _embed(self, texts):
            seen.add(len(texts))
            return super()._embed(texts)

    index = TextIndex(spark.range(200).select(F.col("id").alias("nid"), F.concat(F.lit("word w"), F.col("id")).alias("text")), "nid", "text", Counting())
    return index, seen


def test_a_grounded_search_embeds_every_text_once(spark):
    index, seen = _counted(spark)
    hits = index.retrieve(TextPredicate("d", "word w7", False, False, False), Settings(grounding=True, fetch_k=5))
    assert len(hits.collect()) == 5 and len(hits.collect()) == 5
    assert seen.value == 201  # and the query


def test_reranking_embeds_the_hits_alone(spark):
    index, seen = _counted(spark)
    hits = index.retrieve(TextPredicate("d", "word w7", False, False, True), Settings(search_k=5, reranker_threshold=0.0))
    assert len(hits.collect()) == 5
    assert seen.value <= 200 + 2 * 5 + 2  # every text by the search, hits by the reranker's filter and column, and two queries
