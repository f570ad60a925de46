"""Near-duplicate groups by HyperMinHash sketches, banding and exact verification.

1. Each text becomes M registers: a shingle's hash picks a bucket, and the
   bucket keeps the least remaining hash as its count of leading zeros and the
   MANTISSA bits that follow the first one: 16 bits instead of 64.
2. Equal texts (equal word sequences, 128-bit) are one vertex from here on.
3. Registers, with empty ones filled from others by a fixed probe order, are
   cut into bands; in a bucket of a band every document is first paired with the
   smallest and the largest one, so a bucket of n gives under 2n pairs.
4. A pair's Jaccard index is estimated from the share of equal registers less
   the collisions expected of two sets of these sizes, and dropped only if it
   is three standard errors under the threshold.
5. The rest is verified on the whole sets of shingles.  The best pair between
   two groups goes first, so pairs inside a group that is already proven are
   not verified at all.
6. Verified pairs are closed to groups, named by their smallest doc_id. Then all
   other pairs of a bucket that lie in two groups, or in none, go through 4 and 5
   too, without a cap: copies that are like their original alone are found from
   any place in a bucket. A bucket is first brought down to its groups, so pairs
   within a group are never made: pairs grow with the square of a bucket's
   groups only.

Nothing sorts or holds a bucket in one task: buckets are brought down by
aggregates and met by joins, which can be split where a key is hot.

Defined cases: null doc_id, null text and text without a word belong to no
group. Rows that repeat a doc_id are one document. Texts shorter than a shingle
are compared whole. Ties go to the smaller doc_id, which may be of any type that
can be ordered. Extra columns are ignored by
the search and kept, whatever their names, by `deduplicate`. Empty tables give
empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, buffers, checkpointed, chunks, hidden, keyed, mix, powers, shingles, signed, words, written
from .components import components

M_BITS = 7
M = 1 << M_BITS
MANTISSA = 10
SHINGLE = 3
ROWS = 3
THRESHOLD = 0.55


def registers(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """HyperMinHash registers, n_docs x M of uint16; 0 is an empty register."""
    top = np.full(n_docs * M, ~U64(0), U64)
    bucket = doc.astype(np.int64) * M + (h >> U64(64 - M_BITS)).astype(np.int64)
    np.minimum.at(top, bucket, h << U64(M_BITS))
    full = np.zeros(n_docs * M, bool)
    full[bucket] = True
    x = top[full]
    # 53 leading bits are exact as a float, so its exponent is exact too
    exponent = np.frexp((x >> U64(11)).astype(np.float64))[1]
    zeros = np.minimum(53 - exponent, 53).astype(U64)
    kept = (x << zeros) << U64(1)
    out = np.zeros(n_docs * M, np.uint16)
    out[full] = ((zeros + U64(1)) << U64(MANTISSA) | (kept >> U64(64 - MANTISSA))).astype(np.uint16)
    return out.reshape(n_docs, M)


_PROBES = mix(np.arange(64 * M, dtype=U64)).reshape(64, M) % U64(M)


def densified(reg: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the first full one in a probe order of their own."""
    reg = reg.copy()
    rows = np.flatnonzero((reg == 0).any(1) & (reg != 0).any(1))
    part = reg[rows]
    source = part.copy()
    for probe in _PROBES.astype(np.int64):
        empty = part == 0
        if not empty.any():
            break
        part = np.where(empty, source[:, probe], part)
    for step in range(1, M):  # what 64 probes left goes round
        empty = part == 0
        if not empty.any():
            break
        part = np.where(empty, np.roll(source, -step, 1), part)
    reg[rows] = part
    return reg


def band_keys(reg: np.ndarray) -> np.ndarray:
    """One 64-bit key per document and band of ROWS registers."""
    bands = M // ROWS
    x = densified(reg)[:, : bands * ROWS].astype(U64).reshape(len(reg), bands, ROWS)
    key = x[:, :, 0].copy()
    for j in range(1, ROWS):
        key = (key << U64(16)) | x[:, :, j] if ROWS <= 4 else mix(key) + x[:, :, j]
    return mix(mix(key) + np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15))


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Equal registers that disjoint sets of n and m shingles have by chance.

    For each count of leading zeros: the probability that both buckets' least
    hashes have it, over the equally likely mantissas.
    """
    total = np.zeros(len(n))
    for i in range(1, 54):
        high, low = 2.0 ** (1 - i) / M, 2.0**-i / M

        def p(k: np.ndarray, low: float = low, high: float = high) -> np.ndarray:
            return np.exp(k * np.log1p(-low)) - np.exp(k * np.log1p(-high))

        total += p(n) * p(m)
    return M * total / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and the registers they rest on."""
    used = ((a != 0) | (b != 0)).sum(1)
    equal = ((a == b) & (a != 0)).sum(1)
    est = (equal - expected_collisions(n, m)) / np.maximum(used, 1)
    return np.clip(est, 0, 1), used


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            w = words(*buffers(_lower(part.column(1))))
            count = np.diff(w.first)
            some = np.flatnonzero(count)
            if not len(some):
                continue
            h, d = shingles(w, SHINGLE)
            reg = registers(h, d, part.num_rows)[some]
            at = np.arange(len(w.hash)) - np.repeat(w.first[:-1], count)
            starts = w.first[:-1][some]
            size = int(count.max())
            c1 = mix(np.add.reduceat(w.hash * powers(0xA0761D6478BD642F, size)[at], starts) + count[some].astype(U64))
            c2 = mix(np.add.reduceat(mix(w.hash ^ U64(0xE7037ED1A0B428DB)) * powers(0x8EBC6AF09C88C6E3, size)[at], starts))
            ids = part.column(0).take(pa.array(some))
            yield pa.record_batch(
                [ids, pa.array(signed(c1)), pa.array(signed(c2)), pa.array(np.bincount(d, minlength=part.num_rows)[some]), _fixed(reg)],
                names=["doc_id", "c1", "c2", "n", "sig"],
            )


def _lower(arr: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(arr)


def _fixed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    width = x.shape[1] * x.itemsize
    off = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(col: pa.Array, dtype: type, width: int) -> np.ndarray:
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view(dtype).reshape(len(col), width)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, sig and others: the key of every band with doc_id and the others."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            keys = band_keys(_matrix(part.column(1), np.uint16, M))
            rest = [part.column(c).to_numpy(zero_copy_only=False) for c in range(part.num_columns) if c != 1]
            names = [n for n in part.schema.names if n != part.schema.names[1]]
            yield pa.record_batch([pa.array(signed(keys.ravel())), *(pa.array(np.repeat(x, keys.shape[1])) for x in rest)], names=["key", *names])


def _estimates(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_matrix(batch.column(c), np.uint16, M) for c in ("sa", "sb"))
            n, m = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            est, used = estimate(a, b, n, m)
            keep = est >= threshold - 3 * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(est)], names=["a", "b", "est"]).filter(pa.array(keep))

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct shingles, 32 bits each: at 20,000 words a chance match is worth 0.000005 of the index."""
    for batch in batches:
        for part in chunks(batch):
            w = words(*buffers(_lower(part.column(1))))
            h, d = shingles(w, SHINGLE)
            both = np.unique((d.astype(U64) << U64(32)) | (h >> U64(32)))
            cut = np.searchsorted(both >> U64(32), np.arange(part.num_rows + 1, dtype=U64))
            low = (both & U64(0xFFFFFFFF)).astype(np.uint32)
            arr = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(low)])
            yield pa.record_batch([part.column(0), arr], names=["doc_id", "shingles"])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("xa"), batch.column("xb")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                if min(len(p), len(q)) < threshold * max(len(p), len(q)):
                    ok.append(False)
                    continue
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(common >= threshold * (len(p) + len(q) - common))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _estimated(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, est) of the pairs (a, b) that may reach the threshold."""
    return written(
        pairs.join(sigs.toDF("a", "na", "sa"), "a").join(sigs.toDF("b", "nb", "sb"), "b")
        .mapInArrow(_estimates(threshold), "a long, b long, est double").groupBy("a", "b").agg(F.max("est").alias("est")),
        "pairs",
    )


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def _untried(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(a, b): all pairs of buckets (key, doc_id) whose documents are of different groups, a group-less one being its own."""
    if labels is None:
        grouped = buckets.withColumn("label", F.col("doc_id"))
    else:
        grouped = buckets.join(labels.toDF("doc_id", "label"), "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    grouped = written(grouped, "grouped")
    several = grouped.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    mixed = written(grouped.join(several.hint("merge"), "key"), "mixed")
    groups = mixed.select("key", "label").distinct()
    met = groups.toDF("key", "la").join(groups.toDF("key", "lb").hint("merge"), "key").where("la < lb")
    one = mixed.toDF("key", "a", "la").join(met.hint("merge"), ["key", "la"])
    both = one.join(mixed.toDF("key", "b", "lb").hint("merge"), ["key", "lb"])
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined_up(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """labels (node, label) with the groups that the pairs found tie together; only the groups they touch are walked."""
    if labels is None:
        return checkpointed(components(found))
    la, lb = labels.toDF("a", "ga"), labels.toDF("b", "gb")
    ties = found.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b"))
    new = checkpointed(components(ties))
    moved = labels.join(new.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return checkpointed(moved.union(new.join(labels.select("node"), "node", "left_anti").select("node", "label")))


def _closed(open_: DataFrame, sets: DataFrame, labels: DataFrame | None, threshold: float) -> DataFrame | None:
    """The groups (node, label), with what verification adds from the pairs open_ (a, b, est)."""
    for turn in range(3):  # the best pair between two groups, again, then all that is left
        if labels is not None:
            la, lb = labels.toDF("a", "ga"), labels.toDF("b", "gb")
            open_ = checkpointed(
                open_.join(la, "a", "left").join(lb, "b", "left")
                .select("a", "b", "est", F.coalesce("ga", "a").alias("ga"), F.coalesce("gb", "b").alias("gb")).where("ga <> gb")
            )
        else:
            open_ = open_.withColumns({"ga": F.col("a"), "gb": F.col("b")})
        if turn < 2:
            # turn 0: every document, or group, tries its likeliest partner
            by = [F.col("gb").alias("g")] if turn == 0 else [F.least("ga", "gb").alias("g"), F.greatest("ga", "gb").alias("h")]
            best = F.max(F.struct("est", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("best")
            now = checkpointed(open_.groupBy(*by).agg(best).select((-F.col("best.a")).alias("a"), (-F.col("best.b")).alias("b")))
            open_ = open_.select("a", "b", "est").join(now, ["a", "b"], "left_anti")
        else:
            now = open_.select("a", "b")
        if now.isEmpty():
            break
        found = checkpointed(
            now.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
            .mapInArrow(_verify(threshold), "a long, b long").distinct()
        )
        if not found.isEmpty():
            labels = _joined_up(labels, found)
    return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id) of every document that has a near copy; group_id is the smallest doc_id of its group."""
    base, back = keyed(docs.select("doc_id", "text").where("doc_id is not null and text is not null"), "doc_id")
    signs = written(base.mapInArrow(_signatures, "doc_id long, c1 long, c2 long, n long, sig binary"), "signatures")
    same = signs.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")).hint("merge")
    vertices = written(
        signs.join(same, ["c1", "c2"]).select("doc_id", "rep", "n", F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig")),
        "vertices",
    )
    sigs = vertices.where("sig is not null").select("doc_id", "n", "sig")
    banded = sigs.select("doc_id", "sig").mapInArrow(_bands, "key long, doc_id long")
    ends = banded.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most").hint("merge")
    buckets = written(banded.join(ends, "key").select("key", "doc_id", "least", "most").distinct(), "buckets")
    pairs = (
        buckets.select("doc_id", F.explode(F.array("least", "most")).alias("end")).where("end <> doc_id")
        .select(F.least("doc_id", "end").alias("a"), F.greatest("doc_id", "end").alias("b")).distinct()
    )
    estimated = _estimated(pairs, sigs, threshold)
    wanted = _ends(estimated)
    # the texts meet their ids in a shuffle at every size: the ids grow with the corpus, so they are never broadcast
    sets = written(base.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary"), "shingles")
    labels = _closed(estimated, sets, None, threshold)
    rest = _estimated(_untried(buckets.select("key", "doc_id"), labels).join(pairs, ["a", "b"], "left_anti"), sigs, threshold)
    if not rest.isEmpty():
        more = base.join(_ends(rest).join(wanted, "doc_id", "left_anti").hint("merge"), "doc_id", "left_semi")
        sets = sets.union(written(more.mapInArrow(_sets, "doc_id long, shingles binary"), "shingles"))
        labels = _closed(rest, sets, labels, threshold)
    groups = vertices.select("doc_id", "rep")
    if labels is not None:
        groups = groups.join(labels.toDF("rep", "label"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("rep"))
    # a document of several texts belongs to one group: its rows tie their groups together
    many = groups.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b or a <> doc_id")
    out = checkpointed(many)
    if out.where("a <> b").isEmpty():
        pairs_ = out.select("doc_id", F.col("a").alias("group_id"))
    else:
        ties = groups.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        pairs_ = components(ties).toDF("doc_id", "group_id").where("doc_id <> group_id")
    return back(pairs_.union(pairs_.select(F.col("group_id"), "group_id").distinct()), "doc_id", "group_id")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the near copies: of each group the smallest doc_id stays.

    Of rows that repeat a doc_id the one with the least text stays. Rows of null
    doc_id, null text or no words all stay, as do all columns.
    """
    groups = near_duplicates(docs, threshold)
    drop = checkpointed(groups.where("doc_id <> group_id").select(F.col("doc_id").alias("gone")))
    n, at, row = hidden(docs, "rows_of_id", "row_of_id", "row")
    kept = docs.join(drop, docs["doc_id"] == drop["gone"], "left_anti")
    again = checkpointed(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(n)).where(F.col(n) > 1).select(F.col("doc_id").alias(at)))
    if again.isEmpty():
        return kept
    others = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(F.col("text").isNull(), F.col("text"), *others)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.join(again, kept["doc_id"] == again[at], "left_semi").groupBy("doc_id").agg(F.min_by(whole, order).alias(row)).select(f"{row}.*")
    return kept.join(again, kept["doc_id"] == again[at], "left_anti").unionByName(one)
