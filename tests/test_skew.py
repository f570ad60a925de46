"""Joins at nodes that very many rows meet at."""

from pyspark.sql import functions as F

from arcloom.operators import ingest
from arcloom.plans import compile as plans
from arcloom.plans.compile import Engine
from arcloom.plans.dsl import Settings
from arcloom.sources.catalog import GraphCatalog


def _hub(spark):
    """300 suppliers of one nation and 3 of another, in one part."""
    s = spark.range(303).select("id", F.when(F.col("id") < 300, 1).otherwise(2).cast("long").alias("at")).coalesce(1)
    g = GraphCatalog(spark).add_node("S", s, "id").add_node("N", spark.createDataFrame([(1,), (2,), (3,)], "n long"), "n")
    g.add_edge("AT", "S", "N", s, "id", "at", key="id", embedded="source")
    hop = lambda label, alias, source, direction: {"edge": {"label": "AT", "direction": direction}, "target": {"label": label, "alias": alias}, "from": source}
    document = {"start": {"label": "S", "alias": "a"}, "traversals": [hop("N", "n", "a", "out"), hop("S", "b", "n", "in")], "return": [{"field": "a.id", "alias": "a"}, {"field": "b.id", "alias": "b"}]}
    return Engine(g, Settings(max_limit=None, auto_sources=False)).plan(document)


def test_pairs_of_one_node_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(plans, "PAIRS", 5_000)
    for broadcast in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        try:
            df = _hub(spark)
            rows = df.withColumn("task", F.spark_partition_id()).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        pairs = {(r["a"], r["b"]) for r in rows}
        assert len(rows) == len(pairs) == 300 * 299 + 3 * 2 and all(a != b for a, b in pairs)
        by_task = {}
        for r in rows:
            by_task[r["task"]] = by_task.get(r["task"], 0) + 1
        assert len(by_task) > 5 and max(by_task.values()) < 30_000


def test_relations_of_one_id_are_not_moved_to_one_task(spark, monkeypatch):
    monkeypatch.setattr(ingest, "HOT", 100)
    ends = spark.createDataFrame([("hub", 1), ("x", 2), ("y", 3)], "local_id string, nid long")
    to = F.when(F.col("id") < 500, "hub").when(F.col("id") < 900, "nowhere").when(F.col("id") < 950, "x").otherwise(F.lit(None))
    rows = spark.range(1000).select("id", to.alias("to_id")).repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ingest.at_ends(rows, ends, "to_id", "dst").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r["id"], r["dst"]) for r in got) == [(i, 1) for i in range(500)] + [(i, 2) for i in range(900, 950)]
    assert len({r["task"] for r in got if r["dst"] == 1}) > 2
