"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the K smallest distinct hashes of a text's shingles of SHINGLE
words, in order.  The sketch of a union is the K smallest of the sketches'
union, so sketches of parts, of documents or of sources merge in any order.
A word's hash is the first 64 bits of its MD5, found once for each distinct word;
a shingle's is their sum, each times the power BASE ** place, and its number of
words times LENGTH, modulo 2 ** 64, through the finaliser of `common.mix`, less
the last bit. SQL can give all that too.

* distinct shingles: the sketch's length if it is under K, else (K - 1) / u
  with u the K-th hash as a fraction of the range;
* resemblance of A and B: the share of the K smallest of the union that is in
  both;
* containment of A in B: common among those, over those that are of A.

`fingerprints` sketches each document's two halves by words (shingles that
begin in the first half, and the others), merges them to the document's sketch,
and estimates how far the halves repeat each other, all in one pass over the
text without a shuffle.  `merged` merges sketches by a column, and
`source_sketches` those of all documents of a source.

`document_pairs` estimates resemblance and containment of every two documents
whose sketches share a hash; all others have an estimate of 0.  There is no cap
on a hash's documents.  Sketches are dealt to blocks, and each pair of blocks is
a cell: one task joins its sketches on the hashes, so no pair is found twice. A
shared hash is in the union's sketch if its ranks in both, less the shared ones
before it, are under K.

Words are runs of ASCII letters, digits and all characters beyond ASCII, with
ASCII letters in lower case. Defined cases: null text has null results; a text
without words an empty sketch, 0 shingles and null resemblance and containment;
fewer words than SHINGLE are one shingle. Halves without a shingle give null
too. Each row is sketched by itself, so repeated rows and null ids need no
care; ties do not occur among distinct hashes. Extra columns are ignored. Empty
tables give empty tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LUT, U64, Words, buffers, chunks, keyed, mix, powers, words, written

SHINGLE = 4
K = 64
#: Documents of a block, and shared hashes taken up at once; neither changes the result.
BLOCK = 1 << 15
AT_ONCE = 2_000_000
RANGE = float(1 << 63)
BASE, LENGTH = 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 20
_known: dict[int, int] = {}
_WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_hashes(text: str, n: int = SHINGLE) -> tuple[list[int], int]:
    """Hashes of all shingles in order, repeats included, and how many begin in the first half: the definition, one by one."""
    w = [int.from_bytes(md5(x.encode()).digest()[:8], "big") for x in _WORD.findall(text.translate(_LOWER))]
    if not w:
        return [], 0
    count, out = max(1, len(w) - n + 1), []
    for i in range(count):
        part = w[i : i + n]
        x = (sum(h * pow(BASE, j, 1 << 64) for j, h in enumerate(part)) + len(part) * LENGTH) % (1 << 64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ x >> shift) * factor % (1 << 64)
        out.append(x >> 1)
    return out, (count + 1) // 2


def bottom(hashes: set[int] | list[int], k: int = K) -> list[int]:
    return sorted(set(hashes))[:k]


def word_hashes(data: np.ndarray, off: np.ndarray, w: Words) -> np.ndarray:
    """MD5 hashes of words, taken once for each that is new to this worker."""
    distinct, index, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    if len(_known) > REMEMBERED:
        _known.clear()
    low = LUT[data].tobytes()
    begin = off[w.doc[index]] + w.start[index]
    for h, a, n in zip(distinct.tolist(), begin.tolist(), (w.end - w.start)[index].tolist()):
        if h not in _known:
            _known[h] = int.from_bytes(md5(low[a : a + n]).digest()[:8], "big")
    return np.array([_known[h] for h in distinct.tolist()], U64)[inverse] if len(distinct) else np.zeros(0, U64)


def text_shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, whether in the second half) of all shingles of a batch, as `shingle_hashes` gives them."""
    data, off = buffers(texts)
    w = words(data, off)
    h, size = word_hashes(data, off, w), np.diff(w.first)
    count = np.where(size > 0, np.maximum(size - n + 1, 1), 0)
    doc = np.repeat(np.arange(len(size)), count)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    at, last = w.first[doc] + inner, w.first[doc] + size[doc]
    total = np.minimum(size, n)[doc].astype(U64) * U64(LENGTH)
    for j, p in enumerate(powers(BASE, n)):
        there = at + j < last
        total[there] += h[(at + j)[there]] * p
    return mix(total) >> U64(1), doc, inner >= ((count + 1) // 2)[doc]


def lowest(h: np.ndarray, group: np.ndarray, groups: int, k: int) -> pa.ListArray:
    """The k smallest distinct hashes of each group, in order."""
    order = np.lexsort((h, group))
    h, group = h[order], group[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (group[1:] != group[:-1])
    h, group = h[new], group[new]
    keep = np.arange(len(h)) - np.searchsorted(group, np.arange(groups))[group] < k
    off = np.concatenate([[0], np.cumsum(np.bincount(group[keep], minlength=groups))]).astype(np.int32)
    return pa.ListArray.from_arrays(off, pa.array(h[keep].astype(np.int64), pa.int64()))


def _sketches(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                text, rows = part.column(1), part.num_rows
                h, doc, second = text_shingles(text, n)
                halves = lowest(h, doc * 2 + second, rows * 2, k)
                gone = text.is_null()
                one, two = (pa.compute.if_else(gone, pa.scalar(None, halves.type), halves.take(pa.array(np.arange(rows) * 2 + i))) for i in (0, 1))
                yield pa.record_batch([part.column(0), one, two], names=["doc_id", "first", "second"])

    return run


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def distinct_estimate(sketch: Column, k: int = K) -> Column:
    full = (k - 1) / (F.element_at(sketch, k).cast("double") / F.lit(RANGE))
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(full)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Null if either sketch is null or empty."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Of a in b. Null if either sketch is null or empty, or none of the union's smallest is of a."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    own = F.size(F.array_intersect(union, a))
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (own > 0), both / own)


def fingerprints(docs: DataFrame, n: int = SHINGLE, k: int = K) -> DataFrame:
    """(doc_id, sketch, n_distinct, self_resemblance, self_containment) of every row; containment is of the second half in the first."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    halves = docs.select("doc_id", "text").mapInArrow(_sketches(n, k), f"doc_id {kind}, first array<long>, second array<long>")
    whole = halves.withColumn("sketch", merge(F.col("first"), F.col("second"), k))
    return whole.select(
        "doc_id",
        "sketch",
        distinct_estimate(F.col("sketch"), k).alias("n_distinct"),
        resemblance(F.col("first"), F.col("second"), k).alias("self_resemblance"),
        containment(F.col("second"), F.col("first"), k).alias("self_containment"),
    )


def merged(sketches: DataFrame, by: str, column: str = "sketch", k: int = K) -> DataFrame:
    """(by, column): one sketch for each value of by, null too; null sketches are as empty ones.

    Each task first merges its own rows, so at most K hashes of a value leave a
    task, however hot the value.
    """

    def reduced(keys: pa.Array, h: np.ndarray) -> pa.RecordBatch:
        coded = keys.dictionary_encode(null_encoding="encode")
        low = lowest(h, coded.indices.to_numpy(), len(coded.dictionary), k)
        owner = np.repeat(np.arange(len(low)), np.asarray(low.value_lengths()))
        return pa.record_batch([coded.dictionary.take(pa.array(owner)), low.flatten()], names=["key", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen = None, None
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.fill_null(lists.value_lengths(), 0)))
            part = reduced(keys.take(pa.array(row)), lists.flatten().to_numpy(zero_copy_only=False))
            if best is not None:
                part = reduced(pa.concat_arrays([best.column(0), part.column(0)]), np.concatenate([best.column(1).to_numpy(), part.column(1).to_numpy()]))
                keys = pa.concat_arrays([seen, keys])
            best, seen = part, keys.unique()
        if best is not None:
            yield best
            yield pa.record_batch([seen, pa.nulls(len(seen), pa.int64())], names=["key", "h"])  # keys without a hash stay

    kind = sketches.schema[by].dataType.simpleString()
    parts = sketches.select(F.col(by).alias("key"), F.col(column).alias("sketch")).mapInArrow(run, f"key {kind}, h long").distinct()
    rank = Window.partitionBy("key").orderBy(F.col("h").asc_nulls_last())
    few = parts.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k)
    return few.groupBy(F.col("key").alias(by)).agg(F.array_sort(F.collect_list("h")).alias(column))


def source_sketches(docs: DataFrame, n: int = SHINGLE, k: int = K) -> DataFrame:
    """(source, sketch, n_distinct) of all documents of each source, null too."""
    one = fingerprints(docs.select(F.col("source").alias("doc_id"), "text"), n, k)
    one = one.withColumn("sketch", F.coalesce("sketch", F.array().cast("array<long>")))
    return merged(one, "doc_id", k=k).select(F.col("doc_id").alias("source"), "sketch", distinct_estimate(F.col("sketch"), k).alias("n_distinct"))


def _matrix(lists: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows, filled up with the greatest number, and their lengths."""
    size = np.asarray(lists.value_lengths())
    out = np.full((len(lists), k), np.iinfo(np.int64).max)
    out[np.arange(k) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, size


def _cell(ids_a: np.ndarray, a: np.ndarray, na: np.ndarray, ids_b: np.ndarray, b: np.ndarray, nb: np.ndarray, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Estimates of the pairs of a row of a and one of b that share a hash; if both are the same block, of each two rows once."""
    row_b, rank_b = np.nonzero(np.arange(k) < nb[:, None])
    order = np.argsort(b[row_b, rank_b], kind="stable")
    row_b, rank_b = row_b[order], rank_b[order]
    there = b[row_b, rank_b]
    row_a, rank_a = np.nonzero(np.arange(k) < na[:, None])
    here = a[row_a, rank_a]
    low = np.searchsorted(there, here, "left")
    count = np.searchsorted(there, here, "right") - low
    total = np.concatenate([[0], np.cumsum(np.bincount(row_a, count, len(a)).astype(np.int64))])
    first = np.searchsorted(row_a, np.arange(len(a) + 1))
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(total, total[i] + AT_ONCE, "right")) - 1)
        s = slice(first[i], first[j])
        c = count[s]
        at = np.repeat(low[s] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        x, y = np.repeat(row_a[s], c), row_b[at]
        ranks = np.repeat(rank_a[s], c) + rank_b[at]
        i = j
        other = ids_a[x] != ids_b[y]
        if same:
            other &= x < y
        x, y, ranks = x[other], y[other], ranks[other]
        if not len(x):
            continue
        key = x * len(b) + y
        order = np.argsort(key, kind="stable")  # a pair's shared hashes stay in the order of their ranks
        key, ranks = key[order], ranks[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        shared = np.diff(np.append(start, len(key)))
        inside = ranks - (np.arange(len(key)) - np.repeat(start, shared)) < k
        both = np.add.reduceat(inside.astype(np.int64), start)
        x, y = key[start] // len(b), key[start] % len(b)
        union = np.minimum(k, na[x] + nb[y] - shared)
        # of a merge of both, the first k + both are the union's sketch: how many of them are of a
        m = union + both
        lo, hi = np.maximum(0, m - nb[y]), np.minimum(m, na[x])
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = a[x, np.minimum(mid, k - 1)] < b[y, np.clip(m - mid - 1, 0, k - 1)]
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        own_a, own_b = lo, m - lo
        p, q = ids_a[x], ids_b[y]
        swap = p > q
        with np.errstate(invalid="ignore", divide="ignore"):
            ab, ba = both / own_a, both / own_b
        ab, ba = np.where(swap, ba, ab), np.where(swap, ab, ba)
        columns = [pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(both / union), pa.array(ab, mask=np.isnan(ab)), pa.array(ba, mask=np.isnan(ba))]
        yield pa.record_batch(columns, names=["a", "b", "resemblance", "a_in_b", "b_in_a"])


def _cells(k: int):
    """Columns doc_id, sketch, i, j, block: the cells (i, j) of a partition one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [x for x in batches if x.num_rows]
        if not batches:
            return
        whole = pa.Table.from_batches(batches).combine_chunks()
        i, j, block = (whole.column(c).to_numpy() for c in ("i", "j", "block"))
        for u, v in sorted(set(zip(i.tolist(), j.tolist()))):
            sides = []
            for side in (u, v):
                part = whole.filter(pa.array((i == u) & (j == v) & (block == side))).combine_chunks()
                if part.num_rows:
                    sides.append((part.column("doc_id").to_numpy(), *_matrix(part.column("sketch").chunk(0), k)))
            if len(sides) == 2:
                yield from _cell(*sides[0], *sides[1], k, u == v)

    return run


def document_pairs(docs: DataFrame, n: int = SHINGLE, k: int = K, block: int = BLOCK) -> DataFrame:
    """(a, b, resemblance, a_in_b, b_in_a) of every two documents, a < b, whose sketches share a hash.

    Rows of null doc_id or without a shingle are in no pair. Identical rows of a
    doc_id are one; versions of one are no pair, but each has its own with others.
    """
    docs, back = keyed(docs.select("doc_id", "text"), "doc_id")
    one = fingerprints(docs, n, k)
    sketches = written(one.where("doc_id is not null and size(sketch) > 0").select("doc_id", "sketch").distinct(), "sketches")
    blocks = max(1, -(-sketches.count() // block))
    dealt = sketches.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = cells.select("doc_id", "sketch", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    pairs = cells.repartition(blocks * (blocks + 1) // 2, "i", "j").mapInArrow(_cells(k), "a long, b long, resemblance double, a_in_b double, b_in_a double")
    return back(pairs, "a", "b")


def sql(n: int = SHINGLE, k: int = K) -> str:
    places = " + ".join(f"coalesce(h[i + {j}]::UHUGEINT * {pow(BASE, j, 1 << 64)}::UHUGEINT % m, 0::UHUGEINT)" for j in range(n))
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, text,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w
           FROM documents),
c AS (SELECT *, CASE WHEN text IS NULL THEN NULL WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - {n - 1}) END AS cnt,
             list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 16))::UBIGINT) AS h, 18446744073709551616::UHUGEINT AS m FROM w),
s AS (SELECT r, i > (cnt + 1) // 2 AS second, m,
             (({places} + least(len(h), {n})::UHUGEINT * {LENGTH}::UHUGEINT) % m)::UBIGINT AS x
      FROM c, LATERAL (SELECT unnest(range(1, cnt + 1)) AS i) WHERE cnt > 0),
s1 AS (SELECT r, second, m, (xor(x, x >> 30)::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT % m)::UBIGINT AS x FROM s),
s2 AS (SELECT r, second, (xor(x, x >> 27)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT % m)::UBIGINT AS x FROM s1),
h AS (SELECT DISTINCT r, second, (xor(x, x >> 31) >> 1)::BIGINT AS h FROM s2),
p AS (SELECT r, second, (list_sort(list(h)))[1:{k}] AS b FROM h GROUP BY r, second),
q AS (SELECT c.r, c.doc_id, c.text IS NULL AS gone,
             coalesce((SELECT b FROM p WHERE p.r = c.r AND NOT second), []) AS f,
             coalesce((SELECT b FROM p WHERE p.r = c.r AND second), []) AS g FROM c),
u AS (SELECT *, (list_sort(list_distinct(list_concat(f, g))))[1:{k}] AS u FROM q),
x AS (SELECT *, len(list_intersect(u, list_intersect(f, g))) AS both_, len(list_intersect(u, g)) AS own FROM u)
SELECT doc_id, CASE WHEN gone THEN NULL ELSE u END AS sketch,
       CASE WHEN gone THEN NULL WHEN len(u) < {k} THEN CAST(len(u) AS DOUBLE) ELSE {k - 1} / (CAST(u[{k}] AS DOUBLE) / {RANGE!r}) END AS n_distinct,
       CASE WHEN len(f) > 0 AND len(g) > 0 THEN CAST(both_ AS DOUBLE) / len(u) END AS self_resemblance,
       CASE WHEN len(f) > 0 AND len(g) > 0 AND own > 0 THEN CAST(both_ AS DOUBLE) / own END AS self_containment
FROM x
"""
