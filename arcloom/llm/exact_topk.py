"""Exact top-k search: every vector against every vector, by tiled products.

The vectors are dealt to blocks; a block is one row, its ids and components as
binary, in 32-bit floats if they came so.  Each two blocks, and each block with
itself, are a cell: one task multiplies them tile by tile, keeps the best of
a tile by partial selection and merges them into the lists so far, of both
blocks' vectors.  The lists of a vector's cells are merged in a tree:
MERGE_WIDTH lists at a time, each level a shuffle of lists only.  A block is
sent once for every block, which is the least for cells of a bounded size:
CELL_BYTES bounds what a task holds.  Fewer vectors are cut into blocks of at
least TILE, about WAVES cells for each core.

Score is the inner product in double precision, summed in the order of the
components. A tile's product only chooses the candidates: all that are not below
the k-th best by more than the product's greatest rounding error are summed
again in that order, so scores do not depend on tiles, and neither small nor
large vectors lose neighbours to rounding. Ties go to the smaller id; a query is
not its own neighbour.

Defined cases: rows with a null id, or a vector that is null, empty, not of the
commonest dimension (ties: the larger) or holds a null, a NaN or an infinity,
are left out. A score that overflows to no number ranks last, as minus infinity.
Rows that repeat an id and vector are one; of several vectors of one id the
largest by element order counts. Ids may be of any type that can be ordered.
With k or fewer others there are fewer neighbours. k < 1 and empty tables give
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, written

TILE = 1024
CELL_BYTES = 64 << 20
WAVES = 3
MERGE_WIDTH = 8
#: Candidates whose components are gathered at once.
AT_ONCE = 1 << 16


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(id, vec) of the usable vectors, and the numpy type of their components."""
    narrow = df.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.col("vec")
    clean = (
        df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("vec"))
        .where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .groupBy("id").agg(F.max("vec").alias("vec"))
    )
    return clean, "<f4" if narrow else "<f8"


def top(row: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each of n rows, in order, from scattered candidates; free places have id -1."""
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    keep = place < k
    best, who = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
    best[row[keep], place[keep]], who[row[keep], place[keep]] = score[keep], ids[keep]
    return best, who


def sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, each summed from the first component on."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return np.where(np.isnan(total), -np.inf, total)


class Lists:
    """The k best neighbours so far of one block's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.best, self.who = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)
        self.size = np.sqrt((vectors * vectors).sum(1))

    def take(self, begin: int, product: np.ndarray, others: "Lists", at: int, same: bool) -> None:
        """Takes up a tile: product is of the vectors from begin on and those of others from at on."""
        (n, m), k = product.shape, self.k
        rows, cols = slice(begin, begin + n), slice(at, at + m)
        # twice the greatest error of a product in any order
        slack = 4.0 * self.vectors.shape[1] * np.finfo(float).eps * self.size[rows] * others.size[cols].max() + np.finfo(float).tiny
        if same and begin == at:
            np.fill_diagonal(product, -np.inf)
        floor = np.where(self.who[rows, -1] >= 0, self.best[rows, -1] - slack, -np.inf)
        near = ~(product < floor[:, None])
        if m > k and near.sum() > 4 * k * n:
            tile = np.partition(np.where(np.isnan(product), np.inf, product), m - k, axis=1)[:, m - k]
            near &= ~(product < (tile - 2 * slack)[:, None])
        i, j = np.nonzero(near)
        if same and begin == at:
            i, j = i[i != j], j[i != j]
        for a in range(0, len(i), AT_ONCE):
            x, y = i[a : a + AT_ONCE], j[a : a + AT_ONCE]
            score = sums(self.vectors[begin + x], others.vectors[at + y]) + 0.0
            have, place = np.nonzero(self.who[rows] >= 0)
            self.best[rows], self.who[rows] = top(
                np.concatenate([have, x]), np.concatenate([self.best[rows][have, place], score]), np.concatenate([self.who[rows][have, place], others.ids[at + y]]), n, k
            )


def _cells(k: int, kind: str):
    """Columns cell, part, other, ids, vecs, one row a block: (query, cell, ids, scores), the lists of each cell's vectors."""

    def batch(lists: Lists, cell: int) -> pa.RecordBatch:
        full = lists.who >= 0
        off = np.concatenate([[0], np.cumsum(full.sum(1))]).astype(np.int32)
        return pa.record_batch(
            [pa.array(lists.ids), pa.array(np.full(len(lists.ids), cell, np.int32)), pa.ListArray.from_arrays(off, pa.array(lists.who[full])), pa.ListArray.from_arrays(off, pa.array(lists.best[full]))],
            names=["query", "cell", "ids", "scores"],
        )

    def block(ids: bytes, vecs: bytes) -> Lists:
        i = np.frombuffer(ids, np.int64)
        with np.errstate(over="ignore"):
            return Lists(i, np.frombuffer(vecs, kind).reshape(len(i), -1).astype(float), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[int, Lists]] = {}
        for got in batches:
            for r in range(got.num_rows):
                cell, part, other = (got.column(c)[r].as_py() for c in range(3))
                mine = block(got.column(3)[r].as_buffer(), got.column(4)[r].as_buffer())
                if part == other:
                    theirs = mine
                elif cell in waiting:
                    theirs = waiting.pop(cell)[1]
                else:
                    waiting[cell] = (part, mine)
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    for a in range(0, len(mine.ids), TILE):
                        for b in range(0, len(theirs.ids), TILE):
                            product = mine.vectors[a : a + TILE] @ theirs.vectors[b : b + TILE].T
                            if theirs is not mine:
                                theirs.take(b, product.T, mine, a, False)
                            mine.take(a, product, theirs, b, theirs is mine)
                yield batch(mine, other)
                if theirs is not mine:
                    yield batch(theirs, part)

    return run


def _packed(kind: str):
    def run(part: pa.Table) -> pa.Table:
        ids = part.column("id").combine_chunks().to_numpy()
        vecs = part.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
        return pa.table({"part": pa.array([part.column("part")[0].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vecs": pa.array([vecs.tobytes()], pa.binary())})

    return run


def exact_top_k(df: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", cell_bytes: int = CELL_BYTES, block_rows: int | None = None) -> DataFrame:
    """(query_id, rank, neighbor_id, score) of the k best neighbours of every vector, rank from 1."""
    spark = df.sparkSession
    df, back = keyed(df.select(id_col, vector_col), id_col)
    empty = back(spark.createDataFrame([], "query_id long, rank int, neighbor_id long, score double"), "query_id", "neighbor_id")
    if k < 1:
        return empty
    vec, kind = _vectors(df, id_col, vector_col)
    sizes = vec.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return empty
    dim, count = sizes["d"], sizes["count"]
    block_rows = block_rows or max(TILE, math.ceil(count / math.sqrt(2 * WAVES * spark.sparkContext.defaultParallelism)))
    each = max(1, min(block_rows, cell_bytes // 2 // (dim * np.dtype(kind).itemsize)))
    parts = math.ceil(count / each)
    vec = vec.where(F.size("vec") == dim).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    blocks = written(vec.groupBy("part").applyInArrow(_packed(kind), "part int, ids binary, vecs binary"), "blocks")
    low, high = F.least("part", "other"), F.greatest("part", "other")
    cells = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
        (high * (high + 1) / 2 + low).cast("int").alias("cell"), "part", "other", "ids", "vecs"
    )
    lists = cells.repartitionById(parts * (parts + 1) // 2, F.col("cell")).mapInArrow(_cells(k, kind), "query long, cell int, ids array<long>, scores array<double>")
    both = F.arrays_zip("scores", "ids")
    lists = lists.select("query", "cell", F.transform(both, lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("i"))).alias("top"))
    width = parts
    while width > 1:
        lists = (
            lists.groupBy("query", F.floor(F.col("cell") / MERGE_WIDTH).cast("int").alias("cell"))
            .agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        )
        width = math.ceil(width / MERGE_WIDTH)
    hits = lists.select("query", F.posexplode("top").alias("pos", "hit")).select(
        F.col("query").alias("query_id"), (F.col("pos") + 1).alias("rank"), F.col("hit.i").alias("neighbor_id"), (0.0 - F.col("hit.s")).alias("score")
    )
    return back(hits, "query_id", "neighbor_id")


SQL = """
WITH v AS (SELECT vec_id, max(CAST(embedding AS DOUBLE[])) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY vec_id),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_dot_product(a.e, b.e) + 0.0 AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, score FROM r WHERE rank <= 10
"""
