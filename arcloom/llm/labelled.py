"""A bounded, balanced sample of labelled documents, and a model fitted on it in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """(doc_id, text, y): at most per_class rows of y = 0 and of y = 1.

    Chosen by a hash of doc_id among all labelled ids, of any type. Null labels,
    ids and texts are left out; of several labels of one id the largest counts,
    of several texts of one id the least.
    """
    kinds = [t.schema["doc_id"].dataType for t in (docs, labels)]
    if all(isinstance(k, IntegralType) for k in kinds):
        key = F.col("doc_id").cast("long")
    elif kinds[0] == kinds[1]:
        key = F.col("doc_id")
    else:
        key = F.col("doc_id").cast("string")
    known = (
        labels.select(key.alias("doc_id"), F.col(column).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * per_class thin rows, so it may be broadcast
    texts = docs.select(key.alias("doc_id"), "text").where("text is not null")
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fitted(docs: DataFrame, labels: DataFrame, column: str, per_class: int, fit: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Row | None:
    """The one row of fit(sample), run in a single task on the whole sample; None if it gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        if got:
            yield fit(pd.concat(got).sort_values(["doc_id", "text"], kind="stable", ignore_index=True))

    return labelled_sample(docs, labels, column, per_class).repartition(1).mapInPandas(run, schema).first()
