"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import share_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .chat import rotations

    out = rotations(_table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat(m[0].cast("string"), F.lit("-"), m[1].cast("string")))
    return out.withColumn("mask", F.array_join(spans, ","))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"), k=10)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import schedule

    return schedule(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op8_document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import document_pairs

    return document_pairs(_table(spark, sf_dir, "documents"))


def op8_source_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import source_sketches

    return source_sketches(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode, with_bytes

    return with_bytes(encode(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import chat, exact_topk, fingerprints, mixing, substring_dedup

    return {
        "op3_chat_rotation": chat.SQL,
        "op4_exact_topk": exact_topk.SQL,
        "op5_substring_dedup": substring_dedup.sql(),
        "op6_mixing": mixing.sql(),
        "op8_fingerprints": fingerprints.sql(),
    }
