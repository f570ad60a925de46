"""Writes of a vector store: postings of kept rows are kept, texts of unique nids are not sorted or moved."""

from pyspark.sql import functions as F

from arcloom.operators import vector
from arcloom.sources.vectors import VectorStore


def _posted(s):
    return sorted(tuple(r) for r in s.postings("c").select("term", "nid", "tf", "part").collect())


def test_postings_within_a_row_are_those_of_a_grouping(spark):
    docs = spark.createDataFrame([(1, "b a b, B! c7 и a"), (2, ""), (3, "... !"), (4, "a"), (5, "ы " * 50 + "a")], "nid long, text string")
    both = [sorted(tuple(r) for r in vector.postings(docs, unique=u).select("term", "nid", "tf", "part").collect()) for u in (True, False)]
    assert both[0] == both[1] and ("b", 1, 3) in {x[:3] for x in both[0]}
    assert "Exchange" not in vector.postings(docs, unique=True)._jdf.queryExecution().toString()


def test_versions_hold_the_postings_of_their_rows(spark, tmp_path, monkeypatch):
    s = VectorStore(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame([(i, "L", t) for i, t in x], "nid long, label string, text string")
    tokenised = []
    monkeypatch.setattr(vector, "postings", lambda docs, real=vector.postings, **k: (tokenised.append(docs.count()), real(docs, **k))[1])
    s.upsert("c", rows((1, "a b"), (2, "b c"), (2, "b b"), (3, "d"), (4, None)))
    assert {(r["nid"], r["text"]) for r in s.read("c").collect()} == {(1, "a b"), (2, "b c"), (3, "d"), (4, None)}
    s.upsert("c", rows((2, "e e"), (3, "d"), (5, "a")))
    s.delete("c", spark.createDataFrame([(1,), (9,)], "nid long"))
    assert {(r["nid"], r["text"]) for r in s.read("c").collect()} == {(2, "e e"), (3, "d"), (4, None), (5, "a")}
    assert _posted(s) == sorted(tuple(r) for r in vector.postings(s.read("c").where("text is not null")).select("term", "nid", "tf", "part").collect())
    # the first three, the two new ones; not those that stay. The last one is this test's
    assert tokenised == [3, 2, 3]
    assert [r["nid"] for r in s.search("c", "a", 5, mode="lexical").collect()] == [5]
