"""Scores that are equal but for the order of summing tie, and ties go to the smaller nid."""

import itertools
import math

from pyspark.sql import functions as F

from arcloom.operators import vector


def test_bm25_batch_ties_whatever_the_order_of_summing(spark):
    w = lambda n: math.log(1 + (n - 2 + 0.5) / (2 + 0.5))
    # documents of 1 * w + 1 * w + 5 * w and of 7 * w, where the latter is larger in floating point in any order
    n = next(n for n in range(4, 500) if all((a * w(n) + b * w(n)) + c * w(n) < 7 * w(n) for a, b, c in itertools.permutations((1, 1, 5))))
    docs = [(1, "a b c c c c c"), (2, "a " * 7), (3, "b"), (4, "c")] + [(i, "z") for i in range(5, n + 1)]
    got = vector.bm25_batch(spark.createDataFrame([(9, "a b c")], "qid long, qtext string"), spark.createDataFrame(docs, "nid long, text string"), 1).collect()
    assert [r["nid"] for r in got] == [1]


class _Noisy:
    """A reranker whose equal scores differ in the last bit."""

    def score(self, df, query):
        return df.withColumn("rerank", F.when(F.col("nid") == 1, 0.3).otherwise(F.lit(0.1) + F.lit(0.2)))


def test_one_row_of_a_fallback_is_the_smallest_of_equals(spark):
    from arcloom.plans.dsl import Settings
    from arcloom.plans.text import TextIndex, TextPredicate

    index = TextIndex(spark.createDataFrame([(1, "a b"), (2, "a b")], "nid long, text string"), "nid", "text", reranker=_Noisy())
    for grounding in (False, True):
        assert [r["nid"] for r in index.retrieve(TextPredicate("d", "a b", False, True, False), Settings(grounding=grounding, reranker_threshold=0.1)).collect()] == [1]


def test_fusion_ranks_equal_scores_by_nid(spark):
    hits = spark.createDataFrame([(1, 0.3), (2, 0.1 + 0.2), (3, 0.1)], "nid long, score double")
    assert [r["nid"] for r in vector.rrf([hits], 3).collect()] == [1, 2, 3]
