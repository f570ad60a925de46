"""Quality by Bradley-Terry pairwise ranking.

A document is a vector of FEATURES of its form: shares of letters, digits,
capitals, marks and white space, lengths and repetition of words and lines.
From labelled documents PAIRS preference pairs are drawn, good over bad; the
probability that a is preferred to b is the logistic of w (x_a - x_b), and w is
fitted by Newton steps on that loss with a small ridge.  The score of a
document is w x.  Documents under a quantile of all scores are rejected; unless
given, the quantile is the share of bad documents among the labelled ones.

The quantile is taken over every document, by counts of scores rounded to 1/RES
in a range of +-LIMIT, which is where the threshold has to lie anyway; the
table of counts is bounded whatever the corpus.

Defined cases: null text, and text without a byte, score null and are not kept.
Each row is scored by itself; repeated rows count each in the quantile. Scores
equal to the threshold are kept. Labels of one kind only, or none, give no
model: scores are null and every row is kept. Extra columns are ignored. Empty
tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, chunks, mix, words, written
from .labelled import fitted

#: Labelled documents of each class that pairs are drawn from, at most, and pairs.
PER_CLASS = 2000
PAIRS = 20_000
RIDGE = 1e-3
RES, LIMIT = 1000, 50
FEATURES = (
    "log_words", "word_length", "marks", "capitals", "digits", "spaces", "beyond_ascii", "distinct_words", "repeated_words",
    "commonest_word", "repeated_marks", "bars", "lines", "long_words", "capital_words",
)

_KIND = np.zeros(256, np.uint8)
_KIND[[c for c in range(128) if chr(c).isspace()]] = 1
_KIND[[c for c in range(128) if chr(c).isdigit()]] = 2
_KIND[[c for c in range(128) if chr(c).isupper()]] = 3
_KIND[[c for c in range(128) if chr(c).islower()]] = 4
_KIND[128:] = 5


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES per document."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    total = np.maximum(size, 1).astype(float)
    kind = _KIND[data]

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n) / total

    w = words(data, off)
    count = np.maximum(np.bincount(w.doc, minlength=n), 1).astype(float)
    length = w.end - w.start
    pair = mix(w.hash + w.doc.astype(np.uint64))
    _, index, times = np.unique(pair, return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, w.doc[index], times)
    again = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]) if len(w.hash) else np.zeros(0, bool)
    mark = kind == 0
    twice = np.zeros(len(data), bool)
    if len(data):
        twice[1:] = mark[1:] & (data[1:] == data[:-1]) & (doc[1:] == doc[:-1])
    begin = off[w.doc] + w.start
    letters = np.maximum(share((kind == 3) | (kind == 4)), 1e-6)
    capital = (kind[begin] == 3) & (length > 1) & (kind[np.minimum(begin + 1, len(data) - 1)] == 3) if len(begin) else np.zeros(0, bool)
    by_word = lambda mask: np.bincount(w.doc[mask], minlength=n) / count
    return np.stack(
        [
            np.log1p(np.bincount(w.doc, minlength=n)), np.bincount(w.doc, length, n) / count, share(mark), share(kind == 3) / letters, share(kind == 2),
            share(kind == 1), share(kind == 5), np.bincount(w.doc[index], minlength=n) / count / (1 + 0.1 * np.log(count)), by_word(np.concatenate([[False], again]) if len(w.hash) else again),
            most / count, share(twice), share(data == 124), np.log1p(np.bincount(doc[data == 10], minlength=n) / count), by_word(length > 20), by_word(capital),
        ],
        axis=1,
    )


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 0) -> np.ndarray | None:
    """Rows: mean, scale and weight of each feature. None unless both classes are there."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -6, 6)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / pairs + RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.stack([mean, scale, w])


def score(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip((x - model[0]) / model[1], -6, 6) @ model[2]


def _sample_fit(pairs: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = features(*buffers(pa.array(rows["text"].tolist(), pa.large_string())))
        model = fit(x, rows["y"].to_numpy(), pairs)
        return pd.DataFrame({"model": [] if model is None else [model.tobytes()]})

    return run


def quality(docs: DataFrame, labels: DataFrame, quantile: float | None = None, per_class: int = PER_CLASS, pairs: int = PAIRS) -> DataFrame:
    """(doc_id, score, keep) of every row of docs."""
    got = fitted(docs, labels, "quality", per_class, _sample_fit(pairs), "model binary")
    if got is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("keep"))
    box = docs.sparkSession.sparkContext.broadcast(np.frombuffer(got["model"]).reshape(3, -1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                data, off = buffers(part.column(1))
                yield pa.record_batch([part.column(0), pa.array(score(box.value, features(data, off)), mask=np.diff(off) == 0)], names=["doc_id", "score"])

    scored = written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double"), "scores")
    if quantile is None:
        known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("q"))
        quantile = known.agg(F.avg(F.lit(1) - F.col("q"))).first()[0] or 0.0
    cell = F.greatest(F.lit(-LIMIT * RES), F.least(F.lit(LIMIT * RES), F.floor(F.col("score") * RES))).cast("int")
    counts = scored.where("score is not null").groupBy(cell.alias("cell")).count().toPandas().sort_values("cell")  # at most 2 * LIMIT * RES rows
    if len(counts):
        below = counts["count"].cumsum().to_numpy() - counts["count"].to_numpy()
        cut = float(counts["cell"].to_numpy()[below <= quantile * counts["count"].sum()][-1]) / RES
    else:
        cut = 0.0
    return scored.withColumn("keep", F.coalesce(F.floor(F.col("score") * RES) >= round(cut * RES), F.lit(False)))
