"""Vector, lexical and hybrid retrieval.

Queries are few and are literals; the texts are the large side, and each search
is a scan of it with a partial top-k in every task, so only k rows per task
are moved.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from hashlib import md5
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import cosine, norm, sentences

RRF_K = 60
PREFETCH = 4
_SPLIT = r"[^\p{L}\p{N}]+"
_WORD = re.compile(r"\w+")
#: Frequent Russian words, which say nothing in a search.
STOPWORDS = tuple(
    ("а без будет будто бы был была было быть в вам вас вдруг ведь во вот все вы где да даже для до его ее ей ему если есть еще ещё её ж же за и "
     "из или их к как какой когда кто ли меня мне может мы на надо не него ней нет ни нибудь ничего но ну о он она они опять от по под потом "
     "потому раз с сам себе себя со так там тебя теперь то тогда того тоже только тут ты у уж уже чего чем что чтоб этого этот я").split()
)


class Embedder(Protocol):
    dim: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...

    def column(self, c: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, df: DataFrame, query: str) -> DataFrame: ...


#: Words whose places are kept; after that many new ones they are forgotten.
PLACES = 1 << 17
#: Characters of text whose words are placed at once; a longer text makes a slice of its own.
SLICE = 1 << 18


class _Places(dict):
    """Word to place, plus dim if its sign is positive; made when first asked for, at most PLACES kept."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(md5(word.encode()).digest()[:4], "big")
        if len(self) >= PLACES:
            self.clear()
        self[word] = at = h % self.dim + self.dim * ((h >> 16) & 1)
        return at


@lru_cache(maxsize=16)
def _places(dim: int) -> _Places:
    return _Places(dim)


def _slices(texts: Sequence[str | None] | pa.Array) -> Iterator[list[str]]:
    """Texts in their order, SLICE characters at once; null as the empty text."""
    some, size = [], 0
    for text in texts:
        text = (text.as_py() if isinstance(text, pa.Scalar) else text) or ""
        if some and size + len(text) > SLICE:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text) + 64  # many short texts count by their vectors
    if some:
        yield some


class HashingEmbedder:
    """Words hashed into signed places of a unit vector: the same text always gives the same vector, on any machine.

    A word's hash is the first 32 bits of its MD5; its place is the hash modulo
    dim, its sign that of bit 16. In tasks, batches are embedded by slices, so a
    worker holds its batch and the words of one slice.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _embed(self, texts: Sequence[str]) -> np.ndarray:
        places, words, ends = _places(self.dim).__getitem__, [], []
        for text in texts:
            words += map(places, _WORD.findall(text.lower()))
            ends.append(len(words))
        row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        count = np.bincount(row * (2 * self.dim) + np.array(words, np.int64), minlength=len(texts) * 2 * self.dim).reshape(len(texts), 2, self.dim)
        return _units((count[:, 1] - count[:, 0]).astype(float))

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        return np.concatenate([np.zeros((0, self.dim)), *map(self._embed, _slices(texts))])

    def column(self, c: Column) -> Column:
        dim, slices = self.dim, lambda texts: map(self._embed, _slices(texts))

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def run(texts: pa.Array) -> pa.Array:
            flat = np.concatenate([np.zeros(0), *[x.ravel() for x in slices(texts)]])
            return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), pa.array(flat))

        return run(c)

    def cosine(self, c: Column, query: Sequence[float]) -> Column:
        """Cosine of the vectors of texts with one vector, without making columns of vectors."""
        q = _units(np.array([query], float))[0]
        embed = self._embed

        @F.arrow_udf(T.DoubleType())
        def run(texts: pa.Array) -> pa.Array:
            return pa.array(np.concatenate([np.zeros(0), *[embed(x) @ q for x in _slices(texts)]]))

        return run(c)


def likeness(embedder: Embedder, c: Column, query: Sequence[float]) -> Column:
    """Cosine of the embedded texts of a column with a vector, by the embedder itself if it can."""
    if hasattr(embedder, "cosine"):
        return embedder.cosine(c, query)
    return cosine(embedder.column(c), literal_vector(query))


class CosineReranker:
    """Cosine of the embeddings of query and text, at least 0."""

    def __init__(self, embedder: Embedder):
        self.embedder = embedder

    def score(self, df: DataFrame, query: str) -> DataFrame:
        return df.withColumn("rerank", F.greatest(F.lit(0.0), likeness(self.embedder, F.col("text"), self.embedder.embed([query])[0])))


def literal_vector(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def ranked(digits: int = 9) -> list[Column]:
    """The order of hits: by score, rounded far below what one means, so that equal ones tie whatever the order of summing; then by nid."""
    return [F.round("score", digits).desc(), F.col("nid").asc()]


def _best(df: DataFrame, k: int, digits: int = 9) -> DataFrame:
    return df.orderBy(*ranked(digits)).limit(k)


def knn(vectors: DataFrame, query: Sequence[float], k: int, threshold: float | None = None) -> DataFrame:
    """(nid, score): the k rows of vectors (nid, vec) nearest by cosine, over a threshold if given; ties to the smaller nid."""
    return _over(vectors.where("vec is not null").select("nid", cosine(F.col("vec"), literal_vector(query)).alias("score")), k, threshold)


def knn_texts(docs: DataFrame, embedder: Embedder, query: Sequence[float], k: int, threshold: float | None = None) -> DataFrame:
    """knn over texts (nid, text) that have no stored vectors."""
    return _over(docs.where("text is not null").select("nid", likeness(embedder, F.col("text"), query).alias("score")), k, threshold)


def _over(scored: DataFrame, k: int, threshold: float | None) -> DataFrame:
    return _best(scored if threshold is None else scored.where(F.col("score") >= threshold), k)


#: Bytes of query vectors that are sent to every task at once; more queries are asked in parts.
QUERY_BYTES = 64 << 20


def knn_batch(queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """(qid, nid, score) for each row of queries (qid, qvec): the k nearest of vectors (nid, vec) by cosine.

    The queries are those of a request. They are sent as a matrix, QUERY_BYTES at
    once; a task multiplies its batches with it and keeps the k best of each
    query, so no row pairs are made and only short lists are moved. Vectors of
    another dimension are not near anything; ties go to the smaller nid.
    """
    spark = queries.sparkSession
    asked = queries.where("qvec is not null").select("qid", F.col("qvec").cast("array<double>").alias("qvec"))
    size = asked.agg(F.coalesce(F.sum(F.size("qvec")), F.lit(0)).alias("n")).first()["n"] * 8
    parts = max(1, -(-size // QUERY_BYTES))
    source = vectors.where("vec is not null").select("nid", F.col("vec").cast("array<double>").alias("vec"))
    kinds = f"qid long, nid {source.schema['nid'].dataType.simpleString()}, score double"
    found = None
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).collect()  # at most QUERY_BYTES
        by_dim: dict[int, list] = {}
        for i, r in enumerate(rows):
            by_dim.setdefault(len(r["qvec"]), []).append(i)
        box = spark.sparkContext.broadcast({d: (np.array(at), _units(np.array([rows[i]["qvec"] for i in at], float).reshape(len(at), d))) for d, at in by_dim.items()})
        lists = source.mapInArrow(_nearest(box, k, threshold), kinds)
        names = spark.createDataFrame([(i, r["qid"]) for i, r in enumerate(rows)], f"number long, name {queries.schema['qid'].dataType.simpleString()}")
        named = lists.join(names, lists["qid"] == names["number"]).select(F.col("name").alias("qid"), "nid", "score")
        found = named if found is None else found.union(named)
    rank = Window.partitionBy("qid").orderBy(F.desc("score"), "nid")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).drop("rank")


def _units(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _nearest(box, k: int, threshold: float | None):
    """Columns nid, vec: each task's k best (number of the query, nid, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            size = np.asarray(batch.column(1).value_lengths())
            parts = [] if best is None else [best]
            for dim, (numbers, q) in box.value.items():
                mine = pa.array(np.flatnonzero(size == dim))
                if not len(mine):
                    continue
                nids, vecs = batch.column(0).take(mine), batch.column(1).take(mine).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), dim)
                # rounded far below what a score means, so that equal vectors tie whatever the order of summing
                score = np.round(q @ _units(vecs).T, 12)
                score = np.where(np.isnan(score), -np.inf, score)
                if score.shape[1] > k:
                    row, col = np.nonzero(score >= np.partition(score, score.shape[1] - k, axis=1)[:, [score.shape[1] - k]])
                else:
                    row, col = np.nonzero(score > -np.inf)
                s = score[row, col]
                keep = s > -np.inf if threshold is None else s >= threshold
                parts.append(pa.table({"qid": numbers[row[keep]], "nid": nids.take(pa.array(col[keep])), "score": s[keep]}))
            if not parts:
                continue
            both = pa.concat_tables(parts).sort_by([("qid", "ascending"), ("score", "descending"), ("nid", "ascending")])
            number = both.column("qid").to_numpy()
            best = both.filter(pa.array(np.arange(len(number)) - np.searchsorted(number, number) < k))
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return run


def tokens(c: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Lower-case runs of letters and digits, without stop words."""
    parts = F.split(F.lower(c), _SPLIT)
    return F.filter(parts, lambda x: (x != "") & ~x.isin(list(stopwords)))


def query_terms(text: str, stopwords: Sequence[str] = STOPWORDS) -> dict[str, int]:
    import regex

    return Counter(t for t in regex.split(_SPLIT, text.lower()) if t and t not in set(stopwords))


def _times(lowered: Column, term: str) -> Column:
    """How often a term is a token: between characters that are no letters or digits."""
    import regex

    # the term comes first, so that the scan looks for it before anything else
    word = regex.escape(term)
    return F.regexp_count(lowered, F.lit(rf"{word}(?![\p{{L}}\p{{N}}])(?<![\p{{L}}\p{{N}}]{word})"))


def bm25(docs: DataFrame, query: str, k: int, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(nid, score) of the k best of docs (nid, text): sum of tf_q * tf_d * idf over the query's terms.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Two scans without a shuffle of
    texts: one counts documents by term, one scores. Documents without a term
    are no hits.
    """
    terms = query_terms(query, stopwords)
    if not terms:
        return docs.sparkSession.createDataFrame([], docs.select("nid", F.lit(0.0).alias("score")).schema)
    tf = {t: f"__tf{i}" for i, t in enumerate(terms)}
    counted = docs.select("nid", *[_times(F.lower("text"), t).alias(c) for t, c in tf.items()])
    stats = counted.agg(F.count("*").alias("n"), *[F.coalesce(F.sum((F.col(c) > 0).cast("long")), F.lit(0)).alias(c) for c in tf.values()]).first()
    idf = {t: math.log(1 + (stats["n"] - stats[c] + 0.5) / (stats[c] + 0.5)) for t, c in tf.items()}
    score = sum((F.col(c) * F.lit(terms[t] * idf[t]) for t, c in tf.items()), F.lit(0.0))
    hit = sum((F.col(c) for c in tf.values()), F.lit(0)) > 0
    return _best(counted.where(hit).select("nid", score.alias("score")), k)


#: Partitions of stored postings, by a hash of the term.
POSTING_PARTS = 64


def posting_part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(POSTING_PARTS)).cast("int")


def postings(docs: DataFrame, stopwords: Sequence[str] = STOPWORDS, unique: bool = False) -> DataFrame:
    """(term, nid, tf, part) of docs (nid, text): what a lexical search needs, made once when texts are stored.

    If every nid has one row, words are counted within it and nothing is moved.
    """
    if unique:
        words = F.array_sort(tokens(F.col("text"), stopwords))
        # places where another word begins, from 0, and the end
        begins = F.filter(F.transform("w", lambda x, i: F.when((i == 0) | (x != F.get("w", i - 1)), i)), lambda i: i.isNotNull())
        runs = docs.select("nid", words.alias("w")).select("nid", "w", begins.alias("b"))
        counts = F.transform("b", lambda at, i: F.struct(F.get("w", at).alias("term"), (F.coalesce(F.get("b", i + 1), F.size("w")) - at).cast("long").alias("tf")))
        each = runs.select("nid", F.inline(counts)).select("term", "nid", "tf")
    else:
        each = docs.select("nid", F.explode(tokens(F.col("text"), stopwords)).alias("term")).groupBy("term", "nid").agg(F.count("*").alias("tf"))
    return each.withColumn("part", posting_part(F.col("term")))


def bm25_stored(stored: DataFrame, count: int, query: str, k: int, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """bm25 over stored postings of count texts: only the partitions of the query's terms are read, and of them the terms' rows."""
    terms = query_terms(query, stopwords)
    if not terms:
        return stored.sparkSession.createDataFrame([], stored.select("nid", F.lit(0.0).alias("score")).schema)
    mine = stored.where(F.col("part").isin([posting_part(F.lit(t)) for t in terms]) & F.col("term").isin(list(terms)))
    df = {r["term"]: r["df"] for r in mine.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row a term
    weight = F.lit(0.0)
    for t, n in df.items():
        weight = F.when(F.col("term") == t, F.lit(terms[t] * math.log(1 + (count - n + 0.5) / (n + 0.5)))).otherwise(weight)
    return _best(mine.groupBy("nid").agg(F.sum(F.col("tf") * weight).alias("score")), k)


def bm25_batch(queries: DataFrame, docs: DataFrame, k: int, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(qid, nid, score) for each row of queries (qid, qtext), by a join of postings on the term."""
    post = docs.select("nid", F.explode(tokens(F.col("text"), stopwords)).alias("term")).groupBy("term", "nid").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    asked = queries.select("qid", F.explode(tokens(F.col("qtext"), stopwords)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("tq"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").crossJoin(n).select("qid", "term", (F.col("tq") * idf).alias("w"))
    scored = weighed.join(post, "term").groupBy("qid", "nid").agg(F.sum(F.col("w") * F.col("tf")).alias("score"))
    rank = Window.partitionBy("qid").orderBy(*ranked())
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).drop("rank")


def rrf(lists: Sequence[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """(nid, score): reciprocal rank fusion of short lists (nid, score)."""
    parts = []
    for hits in lists:
        rank = Window.orderBy(*ranked())
        parts.append(hits.select("nid", (1.0 / (constant + F.row_number().over(rank))).alias("part")))
    both = parts[0]
    for r in parts[1:]:
        both = both.unionByName(r)
    return _best(both.groupBy("nid").agg(F.sum("part").alias("score")), k, 12)


def fused(dense: DataFrame, lexical: Callable[[int], DataFrame], query: str, k: int, constant: int = RRF_K) -> DataFrame:
    """Dense hits and as many lexical ones, fused; without a term in the query dense alone."""
    if not query_terms(query):
        return dense.limit(k)
    return rrf([dense, lexical(PREFETCH * k)], k, constant)


def hybrid(docs: DataFrame, query: str, vec: Sequence[float], k: int, constant: int = RRF_K, embedder: Embedder | None = None) -> DataFrame:
    """Dense and lexical hits of docs (nid, text, vec), PREFETCH * k each, fused. With an embedder docs need no vec."""
    dense = knn(docs.select("nid", "vec"), vec, PREFETCH * k) if embedder is None else knn_texts(docs, embedder, vec, PREFETCH * k)
    return fused(dense, lambda n: bm25(docs.select("nid", "text"), query, n), query, k, constant)


def maxsim(chunks: DataFrame, embedder: Embedder, query: str, k: int, threshold: float | None = None) -> DataFrame:
    """(nid, score): the k texts of chunks (nid, text) whose best sentence is nearest."""
    each = chunks.select("nid", F.explode(sentences(F.col("text"))).alias("sentence"))
    scored = each.select("nid", likeness(embedder, F.col("sentence"), embedder.embed([query])[0]).alias("s")).groupBy("nid").agg(F.max("s").alias("score"))
    return _over(scored, k, threshold)


def missing_vectors(wanted: DataFrame, index: DataFrame, embedder: Embedder, *key: str) -> DataFrame:
    """Rows of wanted (with text) whose content-addressed id the index lacks, embedded: vec_id, the columns, vec."""
    named = wanted.withColumn("vec_id", F.sha2(F.concat_ws("\u001f", F.lit(str(embedder.dim)), *[F.col(c).cast("string") for c in key], "text"), 256))
    fresh = named.dropDuplicates(["vec_id"]).join(index.select("vec_id"), "vec_id", "left_anti")
    return fresh.withColumn("vec", embedder.column(F.col("text")))


def unit(c: Column) -> Column:
    """A vector scaled to length 1; a null vector stays as it is."""
    n = norm(c)
    return F.when(n > 0, F.transform(c, lambda x: x / n)).otherwise(c)
