"""Repeated passages over documents, by a log-structured index of window hashes.

A passage repeats if WINDOW or more consecutive words stand in two documents.
The first of them, by batch and then by doc_id, owns the passage; in all others
it is a repeat.  Words are as in `common.words`.

The index grows by batches, over many calls if its folder is given, and holds
immutable runs in BUCKETS hash buckets, each sorted by its key, so a new batch is
merge-joined with a run without a shuffle or a sort of history:

* fingerprint runs: hashes of GRAM words, thinned by winnowing, so that every
  WINDOW words hold at least one in any document that has them. While one
  document alone has a fingerprint, the run names it; once two do, it is marked
  as promoted;
* window runs: all windows of WINDOW words around promoted fingerprints, as two
  independent 64-bit hashes, with their owner;
* text runs: the texts, by doc_id.

A batch (1) finds its fingerprints and merge-joins them with the runs; (2) takes
up again the texts that hold a promoted one, and the one older document of each
that is promoted now; (3) hashes all their windows around it and merge-joins them
with the window runs: the second hash verifies the first; (4) gives the windows
that have an older owner as spans of words, and (5) keeps its runs, which are
compacted FANOUT at a time.  Every fingerprint is promoted once, so no old text
is hashed for it again, and windows are kept for repeated text alone.  A batch is
in force once all its runs and its spans are written; one that was lost half way
is done again.

The result does not depend on the number of batches if they follow doc_id.

Defined cases: null doc_id and null text own and repeat nothing. Texts under
WINDOW words neither. Rows that repeat a doc_id are versions of one document:
they do not repeat each other, and identical ones have one set of spans.
Repeats within a document are none. Ids may be of any type that can be ordered;
those of an index are all of one. Extra columns are ignored by the search and
kept by `remove_repeats`, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TIDY, U64, Words, buffers, chunks, hidden, mix, rolling, settings, shared_dir, signed, words

WINDOW = 50
GRAM = 25
FANOUT = 4
BATCHES = 6
#: Ids from which the bounds of batches are taken; they change nothing in the result.
BOUNDS = 10_000


def _slide(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over every w consecutive values, in a pass forward and a pass backward over blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w + w, U64(fill))
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    fore = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - w + 1], fore[w - 1 : n])


def grams(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first word) of every run of gram words in documents of at least window words."""
    h = rolling(w.hash, gram)
    doc = w.doc[: len(h)]
    ok = (doc == w.doc[gram - 1 :]) & (np.diff(w.first)[doc] >= window) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(ok)
    return h[at], doc[at], at


def winnow(h: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """Which hashes are the least of some span consecutive ones of their document; of equal ones all."""
    if len(h) < span:
        return np.zeros(len(h), bool)
    low = _slide(h, span, np.minimum, (1 << 64) - 1)
    low[doc[: len(low)] != doc[span - 1 :]] = 0
    edge = np.zeros(span - 1, U64)
    return _slide(np.concatenate([edge, low, edge]), span, np.maximum, 0) == h


def _fingerprints(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = words(*buffers(part.column(1)))
                h, doc, _ = grams(w, window, gram)
                keep = winnow(h, doc, window - gram + 1)
                h, doc = h[keep], doc[keep]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                yield pa.record_batch([pa.array(signed(h[new])), part.column(0).take(pa.array(doc[new]))], names=["fp", "doc_id"])

    return run


def _windows(window: int, gram: int):
    """Columns doc_id, text, fps, version, fresh: the windows that hold one of fps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = words(*buffers(part.column(1)))
                h, doc, at = grams(w, window, gram)
                lists = part.column(2)
                owner = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                wanted = lists.flatten().to_numpy(zero_copy_only=False).view(U64) ^ mix(owner.astype(U64))
                hit = at[np.isin(h ^ mix(doc.astype(U64)), wanted)]
                # window starts from which the gram is inside, cut to its document
                size = np.diff(w.first)
                lo = np.maximum(hit - (window - gram), w.first[w.doc[hit]])
                hi = np.minimum(hit, w.first[w.doc[hit]] + size[w.doc[hit]] - window)
                mark = np.bincount(lo, minlength=len(w.hash) + 1) - np.bincount(hi + 1, minlength=len(w.hash) + 1)
                start = np.flatnonzero(np.cumsum(mark)[:-1] > 0) if len(hit) else np.zeros(0, np.int64)
                w1, w2 = rolling(w.hash, window), rolling(mix(w.hash ^ U64(0xA5A5A5A5A5A5A5A5)), window, 0x9FB21C651E98DF25)
                d = w.doc[start]
                version = part.column(3).to_numpy(zero_copy_only=False)[d]
                fresh = part.column(4).to_numpy(zero_copy_only=False)[d].astype(bool)
                place = np.where(fresh, (version << 32) | (start - w.first[d]), -2)
                for i in range(0, len(start), 200_000):
                    s = slice(i, i + 200_000)
                    yield pa.record_batch(
                        [pa.array(signed(w1[start[s]])), pa.array(signed(w2[start[s]])), part.column(0).take(pa.array(d[s])), pa.array(place[s])],
                        names=["w1", "w2", "doc_id", "at"],
                    )

    return run


#: Kinds of runs: their columns, and what they are bucketed and sorted by.
RUNS = {
    "fp": ("fp bigint, doc_id {id}, promoted boolean, older {id}", ["fp"]),
    "win": ("w1 bigint, w2 bigint, owner {id}, shared boolean", ["w1", "w2"]),
    "text": ("doc_id {id}, text string", ["doc_id"]),
}
WORK = {"new": "fp bigint, doc_id {id}", "seen": "w1 bigint, w2 bigint, doc_id {id}, at bigint", "spans": "doc_id {id}, version bigint, first_word int, end_word int, owner {id}"}


class FingerprintIndex:
    """The runs of an index in a shared folder, and the operations of a batch.

    A run is a folder named kind-first-last by the batches it covers; a compacted
    run stands for those inside its range, so a job that is lost half way leaves
    the old runs in force.  buckets is fixed when the index is made: as many as
    the session has shuffle partitions, unless given.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None):
        self.spark, self.path, self.window, self.gram = spark, path, window, gram
        self._fs = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        made = [int(name.split("-")[1]) for name in self._names() if name.startswith("buckets-")]
        self.buckets = made[0] if made else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._fs.mkdirs(self._hadoop(f"{path}/buckets-{self.buckets}"))

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self) -> list[str]:
        top = self._hadoop(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []

    def batches(self) -> int:
        """How many batches are in force."""
        return 1 + max((int(name.split("-")[1]) for name in self._names() if name.startswith("batch-")), default=-1)

    def runs(self, kind: str) -> list[tuple[int, int]]:
        """(first, last) batch of the runs in force."""
        done = self.batches()
        found = [tuple(map(int, name.split("-")[1:])) for name in self._names() if name.split("-")[0] == kind]
        found = [r for r in found if r[1] < done and self._fs.exists(self._hadoop(f"{self.path}/{kind}-{r[0]}-{r[1]}/_SUCCESS"))]
        return sorted(r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found))

    def _table(self, kind: str, run: tuple[int, int]) -> str:
        """The name under which a run is known to the session, which plans by its buckets."""
        return f"arcloom_{kind}_" + hashlib.md5(f"{self.path}/{run[0]}-{run[1]}".encode()).hexdigest()

    def _read(self, kind: str, run: tuple[int, int], of: str) -> DataFrame:
        """A run in its buckets."""
        columns, keys = RUNS[kind]
        name, by = self._table(kind, run), ", ".join(keys)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} ({columns.format(id=of)}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}-{run[0]}-{run[1]}'"
            )
        return self.spark.table(name)

    def _append(self, df: DataFrame, kind: str, run: tuple[int, int]) -> None:
        keys = RUNS[kind][1]
        path = f"{self.path}/{kind}-{run[0]}-{run[1]}"
        self._forget(kind, run)
        writer = df.write.format("parquet").bucketBy(self.buckets, *keys).sortBy(*keys).option("path", path)
        writer.mode("overwrite").saveAsTable(self._table(kind, run))

    def _forget(self, kind: str, run: tuple[int, int]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(kind, run)}")
        self._fs.delete(self._hadoop(f"{self.path}/{kind}-{run[0]}-{run[1]}"), True)

    def _worked(self, df: DataFrame, kind: str, number: int, of: str) -> DataFrame:
        path = f"{self.path}/{kind}-{number}-{number}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(WORK[kind].format(id=of)).parquet(path)

    def _plain(self, kind: str, number: int, of: str) -> DataFrame:
        """This batch's run as an ordinary table: joins with it are shuffled, so that hot keys are split."""
        return self.spark.read.schema(RUNS[kind][0].format(id=of)).parquet(f"{self.path}/{kind}-{number}-{number}")

    def _planned(self):
        return settings(self.spark, spark__sql__shuffle__partitions=str(self.buckets), spark__sql__legacy__bucketedTableScan__outputOrdering="true", **TIDY)

    def add(self, batch: DataFrame) -> DataFrame:
        """Spans (doc_id, version, first_word, end_word, owner) of batch (doc_id, text) that repeat, and the batch in the index."""
        number, of = self.batches(), batch.schema["doc_id"].dataType.simpleString()
        own_run = (number, number)
        with self._planned():
            # fewer characters than these have fewer words than a window
            clean = batch.where((F.col("doc_id").isNotNull()) & (F.length("text") >= 2 * self.window - 1)).select("doc_id", "text")
            self._append(clean.repartition(self.buckets, "doc_id"), "text", own_run)
            new = self._worked(self._plain("text", number, of).mapInArrow(_fingerprints(self.window, self.gram), f"fp long, doc_id {of}"), "new", number, of)
            self._append(self._state(new, of), "fp", own_run)
            mine = self._plain("fp", number, of).where("promoted")
            pairs = new.join(mine.select("fp").hint("merge"), "fp").select("doc_id", "fp").union(mine.where("older is not null").select("older", "fp"))
            lists = pairs.groupBy("doc_id").agg(F.collect_set("fp").alias("fps")).hint("merge")
            held = [
                self._read("text", run, of).join(lists, "doc_id")
                .select("doc_id", "text", "fps", F.expr("xxhash64(text) & 2147483647").alias("version"), F.lit(run == own_run).alias("fresh"))
                .mapInArrow(_windows(self.window, self.gram), f"w1 long, w2 long, doc_id {of}, at long")
                for run in [*self.runs("text"), own_run]
            ]
            seen = self._worked(reduce(DataFrame.union, held), "seen", number, of)
            self._append(self._owners(seen, of), "win", own_run)
            shared = self._plain("win", number, of).where("shared").select("w1", "w2", "owner").hint("merge")
            spans = self._worked(self._islands(seen.where("at >= 0").join(shared, ["w1", "w2"]).where("doc_id <> owner")), "spans", number, of)
            self._fs.mkdirs(self._hadoop(f"{self.path}/batch-{number}"))
            for kind in ("new", "seen"):
                self._fs.delete(self._hadoop(f"{self.path}/{kind}-{number}-{number}"), True)
            self.compact(of)
        return spans

    def _state(self, new: DataFrame, of: str) -> DataFrame:
        """Each fingerprint of a batch, its least document, whether two documents have it by now, and the one that had it alone."""
        state = new.groupBy("fp").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        was, older = F.lit(False), F.lit(None).cast(of)
        for i, run in enumerate(self.runs("fp")):
            state = state.join(self._read("fp", run, of).select("fp", F.col("promoted").alias(f"was{i}"), F.col("doc_id").alias(f"older{i}")).hint("merge"), "fp", "left")
            was = was | F.coalesce(F.col(f"was{i}"), F.lit(False))
            older = F.coalesce(F.least(older, F.col(f"older{i}")), older, F.col(f"older{i}"))
        promoted = was | (F.col("a") != F.col("b")) | F.coalesce(older != F.col("a"), F.lit(False))
        return state.select("fp", F.col("a").alias("doc_id"), promoted.alias("promoted"), F.when(~was, older).alias("older"))

    def _owners(self, seen: DataFrame, of: str) -> DataFrame:
        """Each window of a batch with its owner, and whether it is any other's too."""
        own = seen.groupBy("w1", "w2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        history = F.lit(None).cast(of)
        for i, run in enumerate(self.runs("win")):
            own = own.join(self._read("win", run, of).select("w1", "w2", F.col("owner").alias(f"owner{i}")).hint("merge"), ["w1", "w2"], "left")
            history = F.coalesce(F.least(history, F.col(f"owner{i}")), history, F.col(f"owner{i}"))
        owner = F.coalesce(history, F.col("a"))
        return own.select("w1", "w2", owner.alias("owner"), ((F.col("a") != owner) | (F.col("b") != owner)).alias("shared"))

    def _islands(self, dup: DataFrame) -> DataFrame:
        split = dup.select("doc_id", F.expr("shiftright(at, 32)").alias("version"), F.expr("cast(at & 4294967295 as int)").alias("pos"), "owner")
        row = Window.partitionBy("doc_id", "version").orderBy("pos")
        gap = F.col("pos") - F.coalesce(F.lag("pos").over(row), F.lit(-(1 << 30))) > self.window
        return (
            split.withColumn("gap", gap.cast("int"))
            .withColumn("island", F.sum("gap").over(row.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("doc_id", "version", "island")
            .agg(F.min("pos").alias("first_word"), (F.max("pos") + self.window).alias("end_word"), F.min("owner").alias("owner"))
            .drop("island")
        )

    def compact(self, of: str) -> None:
        """Merges the runs of one size when there are FANOUT of them, again and again; buckets stay where they are."""
        for kind, (_, keys) in RUNS.items():
            while True:
                by_size: dict[int, list[tuple[int, int]]] = {}
                for a, b in self.runs(kind):
                    by_size.setdefault(b - a + 1, []).append((a, b))
                group = next((g[:FANOUT] for g in by_size.values() if len(g) >= FANOUT), None)
                if group is None:
                    break
                df = reduce(DataFrame.union, [self._read(kind, run, of) for run in group])
                if kind == "fp":
                    df = df.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.max("promoted").alias("promoted"), F.lit(None).cast(of).alias("older"))
                elif kind == "win":
                    df = df.groupBy(*keys).agg(F.min("owner").alias("owner"), F.max("shared").alias("shared"))
                self._append(df, kind, (group[0][0], group[-1][1]))
                for run in group:
                    self._forget(kind, run)


def _bounds(base: DataFrame, batches: int) -> list:
    """Ids that cut the table into about even batches, from a sample by hash."""
    if batches < 2:
        return []
    some = sorted(r[0] for r in base.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(BOUNDS).collect())
    return sorted({some[len(some) * i // batches - 1] for i in range(1, batches) if len(some) * i // batches})


def _spans(docs: DataFrame, window: int, gram: int, batches: int, path: str | None) -> DataFrame:
    spark = docs.sparkSession
    base = docs.select("doc_id", "text")
    edges = [None, *_bounds(base, batches), None]
    index = FingerprintIndex(spark, path or shared_dir(spark, "substring-index"), window, gram)
    out = []
    for low, high in zip(edges, edges[1:]):
        batch = base if low is None else base.where(F.col("doc_id") > F.lit(low))
        out.append(index.add(batch if high is None else batch.where(F.col("doc_id") <= F.lit(high))))
    return reduce(DataFrame.union, out)


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: str | None = None) -> DataFrame:
    """(doc_id, first_word, end_word, owner_id): words [first, end) of doc_id, from 0, stand in documents before it, of which owner_id is the least.

    index: the folder of an index to look in and to extend; all that it holds is before docs.
    """
    spans = _spans(docs, window, gram, batches, index)
    return spans.select("doc_id", "first_word", "end_word", F.col("owner").alias("owner_id")).distinct()


def _cut(columns: int, text: int, chars: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"c{i}" for i in range(columns)] + ["spans"]
            for part in chunks(batch.rename_columns(names), names[text]):
                data, off = buffers(part.column(text))
                spans = part.column(columns).to_pylist()
                w = words(data, off)
                texts, sizes, keep = part.column(text).to_pylist(), part.column(chars).to_pylist() if chars is not None else [], np.ones(part.num_rows, bool)
                for i, found in enumerate(spans):
                    if not found:
                        continue
                    raw, a, b = data[off[i] : off[i + 1]].tobytes(), w.first[i], w.first[i + 1]
                    start = w.start[a:b]
                    left, done = [], 0
                    for s, e in sorted((s["first_word"], s["end_word"]) for s in found):
                        left.append(raw[done : start[s]])
                        done = start[e] if e < b - a else len(raw)
                    left.append(raw[done:])
                    texts[i] = b"".join(left).decode("utf-8", "replace")
                    keep[i] = any(c.isalnum() for c in texts[i])
                    if chars is not None:
                        sizes[i] = len(texts[i])
                out = list(part.columns[:columns])
                out[text] = pa.array(texts, pa.string())
                if chars is not None:
                    out[chars] = pa.array(sizes, out[chars].type)
                yield pa.record_batch(out, names=batch.schema.names[:columns]).filter(pa.array(keep))

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: str | None = None) -> DataFrame:
    """docs with repeated passages cut out of the text, and n_chars, if there, made to fit.

    A row of which nothing but marks is left goes; all others stay, clean ones
    as they are.
    """
    spans = _spans(docs, window, gram, batches, index)
    (sid, ver, found) = hidden(docs, "span_doc", "span_version", "spans")
    lists = spans.groupBy(F.col("doc_id").alias(sid), F.col("version").alias(ver)).agg(F.collect_list(F.struct("first_word", "end_word")).alias(found))
    joined = docs.join(lists.hint("merge"), (docs["doc_id"] == F.col(sid)) & (F.expr("xxhash64(text) & 2147483647") == F.col(ver)), "left")
    columns = docs.columns
    chars = columns.index("n_chars") if "n_chars" in columns else None
    return joined.select(*[docs[c] for c in columns], found).mapInArrow(_cut(len(columns), columns.index("text"), chars), docs.schema)


def sql(window: int = WINDOW) -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, i - 1 AS pos, md5(array_to_string(w[i : i + {window - 1}], ' ')) AS h
      FROM d, LATERAL (SELECT unnest(range(1, len(w) - {window - 2})) AS i) WHERE len(w) >= {window}),
o AS (SELECT h, min(doc_id) AS owner FROM s GROUP BY h HAVING min(doc_id) <> max(doc_id)),
r AS (SELECT s.doc_id, s.pos, o.owner FROM s JOIN o ON s.h = o.h WHERE s.doc_id <> o.owner),
g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {window} THEN 0 ELSE 1 END AS gap FROM r),
i AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM g)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS first_word, CAST(max(pos) + {window} AS INTEGER) AS end_word, min(owner) AS owner_id
FROM i GROUP BY doc_id, island
"""
