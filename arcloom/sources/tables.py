"""The relational test tables as a property graph."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import GraphCatalog


def table_graph(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    """Nodes and edges over the Parquet tables of a folder; a table is opened when a query needs it."""

    @cache
    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def turn_id(turn: Column) -> Column:
        return F.col("conv_id") * 1000 + turn

    def turns() -> DataFrame:
        return t("conversations").withColumn("turn_id", turn_id(F.col("turn")))

    def follows() -> DataFrame:
        rows = t("conversations").where(F.col("turn") > 0)
        return rows.select(turn_id(F.col("turn") - 1).alias("from_id"), turn_id(F.col("turn")).alias("to_id"), F.col("turn").alias("at"))

    g = GraphCatalog(spark)
    for label, name, key in (
        ("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"),
        ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey"), ("Event", "events", "event_id"), ("Chunk", "documents", "doc_id"),
        ("Page", "pages", "page_id"), ("BenchmarkItem", "benchmark", "item_id"), ("Vec", "embeddings", "vec_id"), ("Label", "labels", "doc_id"),
    ):
        g.add_node(label, lambda name=name: t(name), key)
    g.add_node("Turn", turns, "turn_id")
    g.add_node("Source", lambda: t("documents").where("source is not null").select(F.col("source").alias("name")).distinct(), "name")
    g.add_edge("IN_REGION", "Nation", "Region", lambda: t("nation"), "n_nationkey", "n_regionkey", key="n_nationkey", embedded="source")
    g.add_edge("FROM_NATION", "Customer", "Nation", lambda: t("customer"), "c_custkey", "c_nationkey", key="c_custkey", embedded="source")
    g.add_edge("FROM_NATION", "Supplier", "Nation", lambda: t("supplier"), "s_suppkey", "s_nationkey", key="s_suppkey", embedded="source")
    g.add_edge("PLACED", "Customer", "Order", lambda: t("orders"), "o_custkey", "o_orderkey", key="o_orderkey", embedded="target")
    lines = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    g.add_edge("CONTAINS", "Order", "Part", lambda: t("lineitem"), "l_orderkey", "l_partkey", props=lines)
    g.add_edge("SHIPPED_BY", "Order", "Supplier", lambda: t("lineitem"), "l_orderkey", "l_suppkey", props=lines)
    g.add_edge("SUPPLIES", "Supplier", "Part", lambda: t("lineitem").select("l_suppkey", "l_partkey").distinct(), "l_suppkey", "l_partkey")
    g.add_edge("BY_USER", "Event", "Customer", lambda: t("events"), "event_id", "user_id", key="event_id", embedded="source")
    g.add_edge("part_of", "Chunk", "Source", lambda: t("documents"), "doc_id", "source", key="doc_id", embedded="source")
    g.add_edge("NEXT_TURN", "Turn", "Turn", follows, "from_id", "to_id", key="to_id")
    return g
