"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and gives a DataFrame, which is written as Parquet and read again as the next
one's docs.  Part of the llm subpackage, though it lies at the top.

Every stage keeps rows of null doc_id and rows of null, empty or very long text
unless its docstring says otherwise, counts repeated rows each, settles ties by
doc_id, passes extra columns on whatever their names, gives an empty table for
an empty one, and takes doc_id of any type that can be ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcloom import share_path
from arcloom.llm.bpe import encode
from arcloom.llm.common import written
from arcloom.llm.mixing import mix, placed
from arcloom.llm.near_dedup import deduplicate
from arcloom.llm.substring_dedup import remove_repeats
from arcloom.llm.toxicity import remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; null and empty texts stay, and all do without labels of both classes."""
    share_path(spark)
    return remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least doc_id, and one row of each doc_id; null ids and texts without words stay."""
    share_path(spark)
    return deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that one of a smaller doc_id has; a row that is nothing but such passages goes."""
    share_path(spark)
    return remove_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the weighted mix within its token budget, in its order; those of null source are a source, those without text take no tokens."""
    share_path(spark)
    return mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, position, tokens) of every row, null tokens for null text; position is the place in the mix, null if docs was not read from files."""
    share_path(spark)
    return encode(placed(docs), also=("position",))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: The model of the first stage has no SQL, nor has BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
