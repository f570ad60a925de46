"""Shared pieces of the training-data operators.

Text is read from Arrow buffers and hashed with numpy over whole batches, so no
Python object is made per word.  A word is a maximal run of ASCII letters and
digits and of all bytes above 0x7F; ASCII letters are folded to lower case.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

U64 = np.uint64
_MASK = (1 << 64) - 1
#: Bytes of text hashed at once; a longer document makes its own chunk.
CHUNK_BYTES = 2 << 20


def _lut() -> np.ndarray:
    lut = np.zeros(256, np.uint8)
    for c in range(256):
        if c >= 0x80 or chr(c).isalnum():
            lut[c] = ord(chr(c).lower()) if c < 0x80 else c
    return lut


LUT = _lut()
_BASE = 0x9E3779B97F4A7C15 | 1
_pow_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by need."""
    have = _pow_cache.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024), base & _MASK, U64)
        steps[0] = 1
        have = _pow_cache[base] = np.cumprod(steps, dtype=U64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Words(NamedTuple):
    hash: np.ndarray  # uint64, one per word
    doc: np.ndarray  # index of the word's document in the batch
    start: np.ndarray  # byte offsets within the document
    end: np.ndarray
    first: np.ndarray  # per document: index of its first word; one more at the end


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; nulls are empty."""
    arr = arr.cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("")
    off = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> Words:
    n_docs, n = len(off) - 1, len(data)
    v = LUT[data]
    w = v != 0
    begin, stop = w.copy(), w.copy()
    if n:
        begin[1:] &= ~w[:-1]
        stop[:-1] &= ~w[1:]
        inside = off[:-1][off[:-1] < n]
        begin[inside] = w[inside]
        last = off[1:][off[1:] > 0] - 1
        stop[last] = w[last]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    doc = np.searchsorted(off, start, "right") - 1
    length = end - start
    if len(start):
        at = np.cumsum(length) - length
        inner = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(at, length)
        h = np.add.reduceat(v[w].astype(U64) * powers(_BASE, int(length.max()))[inner], at)
        h = mix(h + length.astype(U64) * U64(0xD6E8FEB86659FD93))
    else:
        h = np.zeros(0, U64)
    first = np.searchsorted(doc, np.arange(n_docs + 1), "left")
    return Words(h, doc, start - off[doc], end - off[doc], first)


def rolling(h: np.ndarray, k: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of every k consecutive word hashes; len(h) - k + 1 of them, across documents."""
    n = len(h)
    if n < k:
        return np.zeros(0, U64)
    if k <= 8:
        out = np.zeros(n - k + 1, U64)
        for j, p in enumerate(powers(base, k)):
            out += h[j : n - k + 1 + j] * p
        return mix(out)
    inverse = pow(base, -1, 1 << 64)
    total = np.zeros(n + 1, U64)
    np.cumsum(h * powers(base, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(inverse, n - k + 1))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of all k-word shingles. A document of fewer words, but some, has one: all its words."""
    r = rolling(w.hash, k)
    inside = w.doc[: len(r)] == w.doc[k - 1 :] if len(r) else np.zeros(0, bool)
    h, d = r[inside], w.doc[: len(r)][inside]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = []
        for i in short:
            x = w.hash[w.first[i] : w.first[i + 1]]
            extra.append(mix((x * powers(0xC2B2AE3D27D4EB4F, len(x))).sum(keepdims=True) + U64(len(x))))
        h, d = np.concatenate([h, *extra]), np.concatenate([d, short])
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about CHUNK_BYTES of text each; whole documents always."""
    col = batch.column(batch.schema.get_field_index(text))
    _, off = buffers(col)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder in the shared checkpoint folder; a local one is set only if the cluster names none."""
    return f"{checkpoint_root(spark)}/{what}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"arcloom-checkpoint-{os.getuid()}")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings of the session, their dots as double underscores, while a job is planned and run; put back after it."""
    conf = {name.replace("__", "."): value for name, value in conf.items()}
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


#: Shuffle files go as soon as the job that needed them has been written.
TIDY = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder: it outlives executors and cuts the lineage."""
    return written(df, "step")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: columns are pruned and counted when it is read again."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    with settings(spark, **TIDY):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, column: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with column as a long in the order of its values, and a function that gives columns of a result their values back.

    Whole numbers are their own key. Values of other types, such as text, are
    sorted and numbered once; df is written with the numbers in their place, so
    all that follows works on longs. Null stays null.
    """
    spark, kind = df.sparkSession, df.schema[column].dataType
    if isinstance(kind, IntegralType):
        return df.withColumn(column, F.col(column).cast("long")), lambda out, *names: out.withColumns({c: F.col(c).cast(kind) for c in names})
    value, number = hidden(df, "value_of_key", "number_of_key")
    ids = df.select(F.col(column).alias(value)).where(F.col(value).isNotNull()).distinct().orderBy(value)
    ids = written(ids.select(value, F.monotonically_increasing_id().alias(number)), "keys")
    changed = df.join(ids.hint("merge"), df[column] == ids[value], "left").select(*[F.col(number).alias(c) if c == column else df[c] for c in df.columns])

    def back(out: DataFrame, *names: str) -> DataFrame:
        columns = out.columns
        for c in names:
            out = out.join(ids.withColumnRenamed(number, f"number_of_{c}").withColumnRenamed(value, f"value_of_{c}"), F.col(c) == F.col(f"number_of_{c}"), "left")
        return out.select(*[F.col(f"value_of_{c}").alias(c) if c in names else F.col(c) for c in columns])

    return written(changed, "keyed"), back


def hidden(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with no column of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out
