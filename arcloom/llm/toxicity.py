"""Toxicity by subword bags: n-gram embeddings, averaged, under a linear softmax.

A word has the n-grams of NGRAMS bytes of "<word>" and itself, each hashed to a
row of the embedding table.  A segment of SEGMENT words is the mean of all its
rows; embeddings and softmax are trained together by gradient descent.  A document is as
toxic as its worst segment, so a few words in a long text are not averaged
away: training starts on whole documents and goes on with each document's
worst segment.  A misspelling shares most n-grams with the word it comes from.

The softmax is linear in the mean, so scoring needs one number per row of the
table (its embedding times the difference of the two class vectors): that is
what is broadcast, BUCKETS floats whatever the corpus.

Defined cases: null text has a null score and is not toxic; text without words
scores 0. Each row is scored by itself, so repeated rows have equal scores.
Without labels of both classes there is no model: scores are null and nothing
is toxic. Empty tables give empty tables. Extra columns are kept by
`remove_toxic` and ignored by `toxicity`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, buffers, chunks, mix, powers, words
from .labelled import fitted

NGRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 8
SEGMENT = 4
#: Distinct words whose n-grams are hashed at once.
SLICE = 20_000
#: A row of the table is trained if so many of the labelled documents have it.
MIN_DOCS = 8
#: Cost of one false alarm, by the share of clean documents, against one miss.
WRONG = 20
#: Share by which the embeddings shrink in an epoch.
DECAY = 0.01
#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 1500


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for each word's n-grams, and where each word's rows begin."""
    length = end - start
    at = np.concatenate([[0], np.cumsum(length + 2)])
    word = np.repeat(np.arange(len(length)), length + 2)
    inner = np.arange(at[-1]) - at[:-1][word]
    body = (inner > 0) & (inner <= length[word])
    v = np.where(inner == 0, ord("<"), ord(">")).astype(U64)
    v[body] = data[(start[word] + inner - 1)[body]]
    rows, owner = [], []
    for n in NGRAMS:
        if len(v) < n:
            continue
        h = np.zeros(len(v) - n + 1, U64)
        for j, p in enumerate(powers(0x100000001B3, n)):
            h += v[j : len(v) - n + 1 + j] * p
        ok = word[: len(h)] == word[n - 1 :]
        rows.append(mix(h[ok] + U64(n)) % U64(BUCKETS))
        owner.append(word[: len(h)][ok])
    whole = np.add.reduceat(v * powers(0x100000001B3, int(length.max()) + 2)[inner], at[:-1]) if len(length) else np.zeros(0, U64)
    rows.append(mix(whole ^ U64(0x5851F42D4C957F2D)) % U64(BUCKETS))
    owner.append(np.arange(len(length)))
    r, o = np.concatenate(rows).astype(np.int32), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    return r[order], np.searchsorted(o[order], np.arange(len(length) + 1))


@dataclass
class Bag:
    """A batch of documents by distinct words and half segments."""

    rows: np.ndarray
    first: np.ndarray  # of each distinct word, in rows
    word: np.ndarray  # distinct word of each word
    half: np.ndarray  # first word of each half segment
    doc: np.ndarray  # document of each half segment

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(half segment, distinct word, times). A word counts once: its repeats are as if they had no embedding."""
        n = len(self.first) - 1
        half_of = np.repeat(np.arange(len(self.half)), np.diff(np.append(self.half, len(self.word))))
        key, times = np.unique(half_of * n + self.word, return_counts=True)
        return key // n, key % n, times


def bag(data: np.ndarray, w: Words) -> Bag:
    _, index, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    # slices keep the arrays over single bytes small
    parts = [subwords(data, w.start[index[a : a + SLICE]], w.end[index[a : a + SLICE]]) for a in range(0, len(index), SLICE)]
    rows = np.concatenate([r for r, _ in parts]) if parts else np.zeros(0, np.int32)
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))]) if parts else np.zeros(1, np.int64)
    count = np.diff(w.first)
    inner = np.arange(len(w.hash)) - np.repeat(w.first[:-1], count)
    half = np.flatnonzero(inner % (SEGMENT // 2) == 0)
    return Bag(rows, first, inverse, half, w.doc[half])


def _batch(texts: pa.Array) -> tuple[np.ndarray, Words]:
    data, off = buffers(pc.utf8_lower(texts))
    w = words(data, off)
    return data, w._replace(start=w.start + off[w.doc], end=w.end + off[w.doc])


def _sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of x that begin at first; no run is empty."""
    return np.add.reduceat(x, first, axis=0) if len(first) else np.zeros((0, *x.shape[1:]))


def _windows(half: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment is a half and the next of its document; a lone or last half counts only if it is lone."""
    follows = np.concatenate([doc[:-1] == doc[1:], [False]]) if len(doc) else np.zeros(0, bool)
    lone = ~follows & ~np.concatenate([[False], follows[:-1]]) if len(doc) else follows
    total = half + np.where(follows.reshape(-1, *[1] * (half.ndim - 1)), np.concatenate([half[1:], half[:1]]), 0)
    keep = follows | lone
    return total[keep], doc[keep]


@dataclass
class Model:
    weight: np.ndarray  # per row of the table: embedding times the difference of the class vectors
    bias: float
    threshold: float

    def segments(self, b: Bag) -> tuple[np.ndarray, np.ndarray]:
        half, word, _ = b.pairs()
        gain = np.bincount(half, _sum(self.weight[b.rows], b.first[:-1])[word], len(b.half))
        size = _sum(np.diff(b.first)[b.word], b.half)
        total, doc = _windows(np.stack([gain, size], 1), b.doc)
        return total[:, 0] / total[:, 1] + self.bias, doc

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of the worst segment; 0 without words."""
        data, w = _batch(texts)
        out = np.full(len(texts), -np.inf)
        if len(w.hash):
            logit, doc = self.segments(bag(data, w))
            np.maximum.at(out, doc, logit)
        return np.where(np.isinf(out), 0.0, 1 / (1 + np.exp(-np.clip(out, -700, 700))))


def fit(texts: list[str], y: np.ndarray, seed: int = 0, warm: int = 10, epochs: int = 40, rate: float = 0.5) -> Model | None:
    """Embeddings, softmax and threshold from labelled texts; None unless both classes are there.

    Gradient descent with momentum on all documents, each class of the same
    weight; the step is scaled by the largest gradient, not by each row's own,
    so rows seen in few documents stay small.  Rows of fewer than MIN_DOCS
    documents are not trained.  A fifth is held out for the threshold and for
    the choice of the epoch.
    """
    y = np.asarray(y, int)
    if len(set(y.tolist())) < 2:
        return None
    data, w = _batch(pa.array(texts, pa.large_string()))
    b = bag(data, w)
    if not len(b.word):
        return None
    rng = np.random.default_rng(seed)
    n_docs, n_words, n_half = len(texts), len(b.first) - 1, len(b.half)
    size = np.diff(b.first).astype(float)
    owner = np.repeat(np.arange(n_words, dtype=np.int32), np.diff(b.first))
    ph, pw, times = b.pairs()
    half_n = np.bincount(ph, size[pw] * times, n_half)
    df = np.zeros(BUCKETS, np.int64)  # documents by row of the table
    of_doc = np.searchsorted(b.doc[ph], np.arange(n_docs + 1))
    for d in range(n_docs):
        mine = np.unique(pw[of_doc[d] : of_doc[d + 1]])
        count = b.first[mine + 1] - b.first[mine]
        at = np.repeat(b.first[mine] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        df[np.unique(b.rows[at])] += 1
    keep = df[b.rows] >= min(MIN_DOCS, max(1, n_docs // 8))
    used, rows = np.unique(b.rows[keep], return_inverse=True)
    owner = owner[keep]
    known = np.zeros(n_words, bool)
    known[owner] = True
    live = known[pw]
    ph, pw = ph[live], pw[live]
    emb = rng.normal(0, 0.01, (len(used), DIM))
    soft, bias = np.tile([[-1.0, 1.0]], (DIM, 1)) + rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    params = [emb, soft, bias]
    moved = [np.zeros_like(p) for p in params]
    held = np.zeros(n_docs, bool)
    for c in (0, 1):
        mine = rng.permutation(np.flatnonzero(y == c))
        held[mine[: len(mine) // 5]] = True
    weight_of = ((1 / np.maximum(np.bincount(y[~held], minlength=2), 1))[y]) * ~held
    doc_rows, doc_first = np.unique(b.doc, return_index=True)
    unit = np.searchsorted(doc_rows, b.doc)
    best: tuple[float, np.ndarray, float] = (np.inf, np.zeros(0), 0.0)
    for epoch in range(warm + epochs):
        # two classes: the logits differ by mean @ u + bias, so one number per row goes up and one comes down
        u = soft[:, 1] - soft[:, 0]
        half = np.bincount(ph, np.bincount(owner, (emb @ u)[rows], n_words)[pw], n_half)
        if epoch < warm:
            docs_, total, n = doc_rows, np.add.reduceat(half, doc_first), np.add.reduceat(half_n, doc_first)
            part = worst = np.ones(len(docs_), bool)
        else:
            seg, seg_doc = _windows(np.column_stack([half, half_n, np.arange(n_half), np.ones(n_half)]), b.doc)
            order = np.lexsort((-seg[:, 0] / seg[:, 1], seg_doc))
            first = np.concatenate([[True], seg_doc[order][1:] != seg_doc[order][:-1]])
            worst = np.zeros(len(seg), bool)
            worst[order[first]] = True
            take = np.flatnonzero(worst | (y[seg_doc] == 0))
            docs_, total, n, worst = seg_doc[take], seg[take, 0], seg[take, 1], worst[take]
            two = seg[take, 3] > 1
            left = np.where(two, (seg[take, 2] - 1) / 2, seg[take, 2]).astype(int)
            # every segment of a clean document is clean; of a toxic one, the worst is toxic
            part = np.where(y[docs_] == 1, 1.0, 0.5 * worst + 0.5 / np.bincount(docs_)[docs_])
        p = 1 / (1 + np.exp(-np.clip(total / n + bias[1] - bias[0], -50, 50)))
        if epoch >= warm:
            own = np.where(y[docs_] == 1, p, 1 - p)
            use = worst & (held[docs_] if held.any() else True)
            loss = sum(-np.log(np.maximum(own[use & (y[docs_] == c)], 1e-3)).mean() for c in (0, 1) if (use & (y[docs_] == c)).any())
            if loss < best[0]:
                best = (loss, emb @ u, float(bias[1] - bias[0]))
        g = (p - y[docs_]) * weight_of[docs_] * part
        if epoch < warm:
            g_half = (g / n)[unit]
        else:
            g_half = np.bincount(np.concatenate([left, left[two] + 1]), np.concatenate([g / n, (g / n)[two]]), n_half)
        g_row = np.bincount(rows, np.bincount(pw, g_half[ph], n_words)[owner], len(used))
        g_emb, g_soft = np.outer(g_row, u), emb.T @ g_row
        scale = (rate / max(np.abs(g_emb).max(), 1e-12), 0.3, 0.3)
        for q, d, m, s in zip(params, (g_emb, np.stack([-g_soft, g_soft], 1), np.array([-g.sum(), g.sum()])), moved, scale):
            m *= 0.8
            m += d * s
            q -= m
        emb *= 1 - DECAY
    weight = np.zeros(BUCKETS)
    weight[used] = best[1]
    model = Model(weight, best[2], 0.5)
    model.threshold = _threshold(model, b, y, held, n_docs)
    return model


def _threshold(model: Model, b: Bag, y: np.ndarray, held: np.ndarray, n: int) -> float:
    """Middle of the gap, among held-out scores, whose recall less WRONG times the false alarms is best; ties to the higher."""
    logit, doc = model.segments(b)
    score = np.full(n, -50.0)
    np.maximum.at(score, doc, logit)
    use = held if len(set(y[held].tolist())) == 2 else np.ones(n, bool)
    s, t = score[use], y[use]
    cuts = np.unique(s)
    gain = np.array([(s[t == 1] >= c).mean() - WRONG * (s[t == 0] >= c).mean() for c in cuts])
    best = len(cuts) - 1 - int(np.argmax(gain[::-1]))
    low = cuts[best - 1] if best else cuts[best] - 1
    return float(1 / (1 + np.exp(-(0.5 * cuts[best] + 0.5 * low))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """The model of a bounded, balanced sample, fitted in one task; the driver gets the weights only."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        model = fit(rows["text"].tolist(), rows["y"].to_numpy())
        if model is None:
            return pd.DataFrame({"weight": [], "bias": [], "threshold": []})
        return pd.DataFrame({"weight": [model.weight.astype(np.float32).tobytes()], "bias": [model.bias], "threshold": [model.threshold]})

    got = fitted(docs, labels, "toxic", per_class, run, "weight binary, bias double, threshold double")
    return got and Model(np.frombuffer(got["weight"], np.float32), got["bias"], got["threshold"])


def _scored(docs: DataFrame, model: Model | None, columns: list[str], score: str) -> DataFrame:
    if model is None:
        return docs.select(*columns, F.lit(None).cast("double").alias(score))
    box = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    source = docs.select(*columns, F.col("text"))
    schema = docs.select(*columns, F.lit(None).cast("double").alias(score)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = box.value
        m = Model(weight, bias, 0.5)
        for batch in batches:
            text = batch.num_columns - 1
            for part in chunks(batch.rename_columns([f"c{i}" for i in range(text)] + ["text"])):
                col = part.column(text)
                got = pa.array(m.score(col), mask=np.asarray(pc.is_null(col)))
                yield pa.record_batch([*part.columns[:text], got], names=[*columns, score])

    return source.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, toxicity, toxic) of every row of docs."""
    model = train(docs, labels, per_class)
    cut = model.threshold if model else 2.0
    return _scored(docs, model, ["doc_id"], "toxicity").withColumn("toxic", F.coalesce(F.col("toxicity") >= cut, F.lit(False)))


def remove_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns; one pass, nothing is shuffled."""
    model = train(docs, labels, per_class)
    if model is None:
        return docs
    box = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.threshold))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, cut = box.value
        m = Model(weight, bias, cut)
        for batch in batches:
            for part in chunks(batch.rename_columns([f"c{i}" if i != at else "text" for i in range(batch.num_columns)])):
                good = m.score(part.column(at)) < cut
                yield part.rename_columns(batch.schema.names).filter(pa.array(good | np.asarray(pc.is_null(part.column(at)))))

    return docs.mapInArrow(run, docs.schema)
