"""Token counts of texts of any length by overlap resynchronisation.

A text of over HUGE characters is encoded in overlapping chunks, in parallel,
each with the offsets of its tokens.  Two neighbours are spliced where both
have a token boundary that is also a pre-token boundary, three characters or
more before the left one's end: from there on the right chunk's tokens are the
whole text's, as the pre-token pattern never looks behind and merges stay
within a pre-token.  If the overlap has no such place it is doubled and
encoded again.  The count is the sum over the spliced stretches; only the
boundaries in the overlaps, with the tokens before them, leave a chunk, and
its text for the case that it must be widened.

Defined cases: null text has a null count, empty text 0. Each row is counted by
itself: repeated rows and null ids give as many rows. Extra columns are
ignored. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CHUNK, HUGE, OVERLAP, VOCABULARY, Codec, _slices, chunk_rows, codec, long_rows, row_schema, spread, stitch, whole, zones


def token_offsets(c: Codec, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Pre-token boundaries of text in characters, and the number of tokens before each."""
    found = c.boundaries(text, 0, len(text))
    ends = np.cumsum(c.sizes[c.encode(text)])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(wide)])[found]
    return found, np.searchsorted(ends, at, "right")


def _counted(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, piece in zip(batch.column("i").to_pylist(), batch.column("piece").to_pylist()):
                found, before = token_offsets(c, piece)
                head, tail = zones(found, i, len(piece), chunk, overlap)
                where = dict(zip((found + i * chunk).tolist(), before.tolist()))
                for k, zone in ((0, head), (2, tail)):
                    # a text's own end is a boundary too, for the last stretch
                    zone = np.union1d(zone, [i * chunk + len(piece)]) if k else zone
                    out[k].append(zone.tolist())
                    out[k + 1].append([where[x] for x in zone.tolist()])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in out]
            yield pa.record_batch([*batch.columns, *lists], names=[*batch.schema.names, "heads", "head_tokens", "tails", "tail_tokens"])

    return run


def _spliced(path: str, chunk: int, overlap: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = codec(path)
        pdf = pdf.sort_values("i")
        text, n = whole(pdf, chunk), len(pdf)
        heads = [dict(zip(h, t)) for h, t in zip(pdf["heads"], pdf["head_tokens"])]
        tails = [dict(zip(h, t)) for h, t in zip(pdf["tails"], pdf["tail_tokens"])]
        proven = [np.array(sorted(x for x in t if x <= min(len(text), (i + 1) * chunk + overlap) - 3), np.int64) for i, t in enumerate(tails)]
        cuts = stitch(c, text, [np.array(sorted(h), np.int64) for h in heads], proven, chunk, overlap)
        total = 0
        for a, b in zip(cuts, cuts[1:]):
            i = min(a // chunk, n - 1)
            # a stretch is of chunk i if both of its ends are boundaries of that chunk's own encoding
            if a in heads[i] and b in tails[i]:
                total += tails[i][b] - heads[i][a]
            else:
                total += len(c.encode(text[a:b]))
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "times": [pdf["times"].iloc[0]], "n_tokens": [total]})

    return run


def _short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in _slices(batch, 1):
                n = [None if t is None else len(c.encoding.encode_ordinary(t)) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    short = docs.where(F.coalesce(F.length("text") <= huge, F.lit(True))).mapInArrow(_short(vocabulary), f"doc_id {kind}, n_tokens long")
    row = row_schema(docs, ["doc_id"])
    counted = chunk_rows(long_rows(docs, huge, ["doc_id"]), chunk, overlap, ["doc_id"]).mapInArrow(
        _counted(vocabulary, chunk, overlap),
        f"{row}, i int, piece string, heads array<long>, head_tokens array<long>, tails array<long>, tail_tokens array<long>",
    )
    sums = counted.groupBy("rid").applyInPandas(_spliced(vocabulary, chunk, overlap), f"doc_id {kind}, times long, n_tokens long")
    return short.unionByName(spread(sums, ["doc_id"], "n_tokens"))
