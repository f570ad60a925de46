"""Byte-level BPE encoding and decoding of texts of any length.

A text of over HUGE characters is cut into chunks of CHUNK that share OVERLAP
characters with the next one.  The chunks are rows of their own and are cut
into pre-tokens in parallel, each as if it were a text.  The pattern looks
ahead, by at most three characters past what it has matched, but never behind,
so what follows a boundary depends on nothing before it.  Where two
neighbours have a boundary at one place, not after white space, that the left
one proves (three characters before its end), they are stitched there; if they share none, the
overlap is doubled, and in the end the chunks become one.  Merges stay within a
pre-token, so the pieces between stitches are encoded by themselves, in
parallel again, and joined by document.  Shorter texts are encoded where they
are read, without a shuffle.  Decoding joins the tokens' bytes.

Defined cases: null text gives null tokens, empty text none. Each row is
encoded by itself: repeated rows and null ids give as many rows. Extra columns
are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters past a match that may have decided it.
AHEAD = 3
HUGE = 1 << 16
CHUNK = 1 << 14
OVERLAP = 256
#: Characters encoded before a result batch is sent.
BATCH_CHARS = 2 << 20


class Codec:
    """A byte-level BPE vocabulary: text to ids and back."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.sizes = np.array([len(t) for t in table], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, joined."""
        size = self.sizes[ids]
        at = np.repeat(self.begins[ids] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        return self.bytes[at].tobytes()

    def boundaries(self, text: str, begin: int, end: int) -> np.ndarray:
        """Offsets at which pre-tokens of text[begin:end] begin after something else than white space, and end itself.

        White space at the end of a piece would be cut differently without what follows it.
        """
        part = text[begin:end]
        starts = (m.start() for m in self.pattern.finditer(part))
        return np.array([begin + x for x in starts if not x or not part[x - 1].isspace()] + [end], np.int64)


@lru_cache(maxsize=4)
def codec(path: str = VOCABULARY) -> Codec:
    return Codec(path)


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(number, text) of the overlapping chunks."""
    n = max(1, -(-len(text) // chunk))
    return [(i, text[i * chunk : (i + 1) * chunk + overlap]) for i in range(n)]


def zones(found: np.ndarray, i: int, size: int, chunk: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Of chunk i's boundaries (from 0, its size last): those in its first overlap, and the proven ones in its last; absolute."""
    head = found[found <= overlap] + i * chunk
    tail = found[(found >= chunk) & (found <= size - AHEAD)] + i * chunk
    return head, tail


def stitch(c: Codec, text: str, heads: list[np.ndarray], tails: list[np.ndarray], chunk: int, overlap: int) -> list[int]:
    """Offsets, 0 and len(text) included, between which text may be encoded piece by piece."""
    n, cuts = len(text), [0]
    known: np.ndarray | None = tails[0] if tails else None
    for i in range(1, len(heads)):
        start = cuts[-1]
        common = np.intersect1d(known, heads[i]) if known is not None else np.zeros(0, np.int64)
        common = common[common > start]
        wide = overlap
        while not len(common) and wide < chunk:
            wide *= 2
            end = min(n, i * chunk + wide)
            left = c.boundaries(text, start, end)
            if end < n:
                left = left[left <= end - AHEAD]
            right = c.boundaries(text, i * chunk, min(n, end + wide))
            common = np.intersect1d(left[(left >= i * chunk) & (left > start) & (left < n)], right)
        if len(common):
            cuts.append(int(common[0]))
            known = tails[i]
        else:  # no boundary in a whole chunk: it becomes part of the one before
            known = None
    return [*cuts, n]


def long_rows(docs: DataFrame, huge: int, ids: list[str]) -> DataFrame:
    """(rid, ids, text, times): the distinct long rows; rid names them."""
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ids]
    rid = F.sha2(F.concat_ws("/", *named, F.col("text")), 256)
    return (
        docs.where(F.length("text") > huge).groupBy(rid.alias("rid"))
        .agg(*[F.first(f"`{c}`").alias(c) for c in ids], F.first("text").alias("text"), F.count("*").alias("times"))
    )


def row_schema(docs: DataFrame, ids: list[str]) -> str:
    return "rid string, " + "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in ids) + "times long"


def chunk_rows(rows: DataFrame, chunk: int, overlap: int, ids: list[str]) -> DataFrame:
    """(rid, ids, times, i, piece) of the long rows, spread by chunk."""
    same = ["rid", *ids, "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, text in enumerate(batch.column(len(same)).to_pylist()):
                parts = cut(text, chunk, overlap)
                for a in range(0, len(parts), 64):
                    some = parts[a : a + 64]
                    row = [batch.column(c).take(pa.array(np.full(len(some), r))) for c in range(len(same))]
                    yield pa.record_batch([*row, pa.array([i for i, _ in some], pa.int32()), [t for _, t in some]], names=[*same, "i", "piece"])

    return rows.select(*same, "text").mapInArrow(run, f"{row_schema(rows, ids)}, i int, piece string").repartition("rid", "i")


def whole(pdf: pd.DataFrame, chunk: int) -> str:
    """The text of a document's chunks in order."""
    return "".join(p[:chunk] for p in pdf["piece"])


def _pretokenised(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            heads, tails = [], []
            for i, piece in zip(batch.column("i").to_pylist(), batch.column("piece").to_pylist()):
                h, t = zones(c.boundaries(piece, 0, len(piece)), i, len(piece), chunk, overlap)
                heads.append(h)
                tails.append(t)
            yield pa.record_batch([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=[*batch.schema.names, "heads", "tails"])

    return run


def _pieces(path: str, chunk: int, overlap: int, ids: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        text = whole(pdf, chunk)
        cuts = stitch(codec(path), text, [np.asarray(h) for h in pdf["heads"]], [np.asarray(t) for t in pdf["tails"]], chunk, overlap)
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        same = {c: [pdf[c].iloc[0]] * len(parts) for c in ("rid", *ids, "times")}
        return pd.DataFrame({**same, "j": np.arange(len(parts), dtype=np.int32), "piece": parts})

    return run


def _list(parts: list[np.ndarray]) -> pa.ListArray:
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(off, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices whose texts are about BATCH_CHARS long together."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
    i = 0
    while i < batch.num_rows:
        before = size[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(size, before + BATCH_CHARS, "right")))
        yield batch.slice(i, j - i)
        i = j


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            last = batch.num_columns - 1
            for part in _slices(batch, last):
                texts = part.column(last)
                ids = _list([c.encode(t or "") for t in texts.to_pylist()])
                if texts.null_count:
                    ids = pa.compute.if_else(texts.is_null(), pa.scalar(None, ids.type), ids)
                yield pa.record_batch([*part.columns[:last], ids], names=[*part.schema.names[:last], "tokens"])

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns also, tokens) of every row of docs."""
    ids = ["doc_id", *also]
    docs = docs.select(*ids, "text")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids)
    short = docs.where(F.coalesce(F.length("text") <= huge, F.lit(True))).mapInArrow(_encoded(vocabulary), f"{kinds}, tokens array<int>")
    row = row_schema(docs, ids)
    marked = chunk_rows(long_rows(docs, huge, ids), chunk, overlap, ids).mapInArrow(
        _pretokenised(vocabulary, chunk, overlap), f"{row}, i int, piece string, heads array<long>, tails array<long>"
    )
    pieces = marked.groupBy("rid").applyInPandas(_pieces(vocabulary, chunk, overlap, ids), f"{row}, j int, piece string").repartition("rid", "j")
    encoded = pieces.mapInArrow(_encoded(vocabulary), f"{row}, j int, tokens array<int>")
    in_order = F.array_sort(F.collect_list(F.struct("j", "tokens")))
    tokens = F.flatten(F.transform(in_order, lambda x: x["tokens"])).alias("tokens")
    joined = encoded.groupBy("rid").agg(*[F.first(f"`{c}`").alias(c) for c in (*ids, "times")], tokens)
    return short.unionByName(spread(joined, ids, "tokens"))


def spread(rows: DataFrame, ids: list[str], result: str) -> DataFrame:
    """(ids, result) of distinct long rows, as many times as each was there."""
    return rows.select(*ids, result, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy_of_row")).drop("copy_of_row")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, column: str = "tokens", to: str = "text") -> DataFrame:
    """encoded with a column of the decoded text in place of the tokens; null tokens are null text.

    A column that has the name already gives way to it. Bytes that are no UTF-8, as of a cut sequence of tokens, become U+FFFD.
    """
    if to != column:
        encoded = encoded.drop(to)
    at = encoded.columns.index(column)
    names = [to if c == column else c for c in encoded.columns]
    schema = ", ".join(f"`{n}` {'string' if n == to else encoded.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            out = [None if x.values is None else c.decode(x.values.to_numpy(zero_copy_only=False)).decode("utf-8", "replace") for x in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.record_batch(columns, names=names)

    return encoded.mapInArrow(run, schema)


def with_bytes(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, decoded_bytes, decoded_md5, decoded): what decoding gives, as bytes, and their number and digest."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        c = codec(vocabulary)
        for batch in batches:
            n, size, digest, whole = [], [], [], []
            for x in batch.column(1):
                if x.values is None:
                    n.append(None), size.append(None), digest.append(None), whole.append(None)
                    continue
                raw = c.decode(x.values.to_numpy(zero_copy_only=False))
                n.append(len(x.values)), size.append(len(raw)), digest.append(hashlib.md5(raw).hexdigest()), whole.append(raw)
            yield pa.record_batch(
                [*batch.columns, pa.array(n, pa.int32()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(whole, pa.binary())],
                names=["doc_id", "tokens", "n_tokens", "decoded_bytes", "decoded_md5", "decoded"],
            )

    return encoded.select("doc_id", "tokens").mapInArrow(run, f"doc_id {kind}, tokens array<int>, n_tokens int, decoded_bytes long, decoded_md5 string, decoded binary")
