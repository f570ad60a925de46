"""Text filters as retrievals: folding, and the index they run on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import QUERY_HANDLER, Registry, storage_type, typed_op
from ..operators import vector
from .dsl import Filter, Query, Settings

if TYPE_CHECKING:
    from ..operators.vector import Embedder, Reranker
    from ..sources.vectors import VectorStore

_SEARCH = ("search", "search_reranked", "hybrid_search")


@dataclass(frozen=True)
class TextPredicate:
    """All text filters of one alias as one search."""

    alias: str
    query: str
    lexical: bool
    one: bool
    rerank: bool
    #: Filters that hold word for word once a search without grounding has found its rows.
    exact: tuple[Filter, ...] = ()


def _value(f: Filter) -> str:
    if isinstance(f.value, list):
        return " | ".join(str(v) for v in f.value)
    return str(f.value)


def fold_text(q: Query, registry: Registry, types: Mapping[tuple[str, str], str]) -> tuple[list[TextPredicate], list[Filter]]:
    """Retrievals by alias, and the filters that are none.

    A filter on text is folded whatever its operator; neq is retrieved like the
    others, not negated. Any search operator makes the search hybrid, else it is
    lexical. Unless hints agree on something else, one node is meant if all
    operators are eq.
    """
    labels = q.node_aliases()
    by_alias: dict[str, list[Filter]] = {}
    plain = []
    for f in q.filters:
        alias, _, prop = f.field.partition(".")
        kind = f.type
        if kind is None and (labels.get(alias), prop) in types:
            kind = QUERY_HANDLER[storage_type(types[(labels[alias], prop)])]
        if kind is not None and registry.get(kind).type_id == "SemanticText" and alias in labels:
            by_alias.setdefault(alias, []).append(f)
        else:
            plain.append(f)
    out = []
    for alias, fs in by_alias.items():
        ops = [typed_op(f.op) for f in fs]
        for op in ops:
            registry.get("SemanticText")
            if op not in registry.get("SemanticText").supported_ops():
                from ..errors import FieldTypeError

                raise FieldTypeError(f"SemanticText has no operator {op!r}")
        lexical = not any(op in _SEARCH for op in ops)
        if lexical:
            query = " ".join(_value(f) for f in fs)
        else:
            lines = sorted(f"{f.field.partition('.')[2] or 'text'}: {_value(f)}" for f in fs)
            query = "\n".join([f"type: {labels[alias]}", *lines])
        hints = {f.cardinality for f in fs if f.cardinality}
        one = hints == {"one"} if hints else all(op == "eq" for op in ops)
        exact = tuple(f for f, op in zip(fs, ops) if op == "eq" and "." in f.field)
        out.append(TextPredicate(alias, query, lexical, one, "search_reranked" in ops, exact))
    return out, plain


class TextIndex:
    """Nodes of one label with their text and vector; what text filters search."""

    def __init__(self, nodes: DataFrame, nid: str, text: str, embedder: Embedder | None = None, reranker: Reranker | None = None, vectors: str | None = None):
        self.embedder = embedder or vector.HashingEmbedder()
        self.reranker = reranker
        self.collection: tuple[VectorStore, str] | None = None
        base = nodes.select(F.col(f"`{nid}`").alias("nid"), F.col(f"`{text}`").alias("text"), *([F.col(f"`{vectors}`").alias("vec")] if vectors else []))
        self.docs = base.where("text is not null")
        self.stored_vectors = bool(vectors)
        self.with_vectors = self.docs if vectors else self.docs.withColumn("vec", self.embedder.column(F.col("text")))

    @classmethod
    def stored(cls, store: VectorStore, name: str, reranker: Reranker | None = None) -> TextIndex:
        """A collection as an index: its vectors and postings are read, nothing is embedded or tokenised but the query."""
        out = cls(store.read(name), "nid", "text", store.embedder, reranker, "vec")
        out.collection = (store, name)
        return out

    def dense(self, query: str, k: int, threshold: float | None = None) -> DataFrame:
        vec = self.embedder.embed([query])[0]
        return vector.knn(self.with_vectors, vec, k, threshold) if self.stored_vectors else vector.knn_texts(self.docs, self.embedder, vec, k, threshold)

    def lexical(self, query: str, k: int) -> DataFrame:
        if self.collection is not None:
            store, name = self.collection
            return store.lexical(name, query, k)
        return vector.bm25(self.docs, query, k)

    def hybrid(self, query: str, k: int) -> DataFrame:
        return vector.fused(self.dense(query, vector.PREFETCH * k), lambda n: self.lexical(query, n), query, k)

    def found(self, query: str, k: int) -> DataFrame | None:
        """The hits of a hybrid search, at most k rows, searched for once however often they are read; None without any."""
        hits = self.hybrid(query, k)
        rows = hits.collect()
        return hits.sparkSession.createDataFrame(rows, hits.schema) if rows else None

    def texts_of(self, hits: DataFrame) -> DataFrame:
        """Hits, at most k rows, with their texts. They are read here: a reranker's column over a join would be computed for every text of the table."""
        rows = hits.join(self.docs.select("nid", "text"), "nid")
        return hits.sparkSession.createDataFrame(rows.collect(), rows.schema)

    def retrieve(self, p: TextPredicate, s: Settings) -> DataFrame:
        """(nid, score) of the nodes that a predicate pins."""
        if s.grounding:
            # a lexical miss pins nothing; a hybrid one falls back
            hits = self.lexical(p.query, s.fetch_k) if p.lexical else self.found(p.query, s.fetch_k)
            if hits is not None:
                if not p.one:
                    return hits
                if self.reranker is not None:
                    scored = self.reranker.score(self.texts_of(hits), p.query)
                    hits = scored.select("nid", F.col("rerank").alias("score"))
                return hits.orderBy(*vector.ranked()).limit(1)
        if p.one or p.rerank:
            reranker = self.reranker or vector.CosineReranker(self.embedder)
            found = self.hybrid(p.query, s.search_k)
            scored = reranker.score(self.texts_of(found), p.query).where(F.col("rerank") >= s.reranker_threshold)
            best = scored.select("nid", F.col("rerank").alias("score"))
            return best.orderBy(*vector.ranked()).limit(1) if p.one else best
        return self.dense(p.query, s.search_k, s.search_threshold)
