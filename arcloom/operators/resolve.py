"""Entity resolution at ingest: soft-keyed entities that are the same as one seen before take its key.

Vectors of canonical texts are compared within a type: first in the batch, by
greedy clustering in its order, then with stored nodes.  A likeness merges by
itself only if every gate lets it pass; what comes near is listed for review
with the gates that stopped it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import IngestError
from ..functions.scalars import cosine, jaro_winkler, primary_name
from ..functions.scalars import _jaro_winkler as jaro
from ..sources.graph_json import CANONICAL
from .vector import Embedder


@dataclass(frozen=True)
class ResolveConfig:
    similarity_threshold: float = 0.95
    review_threshold: float = 0.75
    auto_merge_threshold: float = 0.96
    min_margin: float = 0.08
    min_lexical_similarity: float = 0.70
    max_close_candidates: int = 1
    close_candidate_delta: float = 0.03
    conflict_properties: tuple[str, ...] = ("id", "email", "url", "isbn", "phone", "ssn", "doi", "ein")
    allow_type_only_auto_merge: bool = False
    review_max_candidates: int = 5
    candidate_k: int = 10


def is_type_only(canonical: Column) -> Column:
    lines = F.filter(F.split(canonical, "\n"), lambda x: F.trim(x) != "")
    return (F.size(lines) == 1) & F.startswith(F.get(lines, F.lit(0)), F.lit("type: "))


def hard_conflict(a: Column, b: Column, names: tuple[str, ...]) -> Column:
    """First of the properties on which two maps of JSON texts both have a value, not empty, and differ; else null."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        x, y = F.element_at(a, F.lit(name)), F.element_at(b, F.lit(name))
        empty = F.lit('""')
        differ = x.isNotNull() & y.isNotNull() & (x != empty) & (y != empty) & (x != "null") & (y != "null") & (x != y)
        out = F.when(differ, F.lit(name)).otherwise(out)
    return out


def gates(hits: DataFrame, cfg: ResolveConfig, by: tuple[str, ...] = ("idx",)) -> DataFrame:
    """One decision per candidate from its hits: idx, canonical, props, hit, hit_canonical, hit_props, score.

    outcome is merge, review or none; reasons names every gate that was shut;
    top and runners_up are what a reviewer sees.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "hit")
    all_ = Window.partitionBy(*by)
    lexical = jaro_winkler(F.lower(primary_name(F.col("canonical"))), F.lower(primary_name(F.col("hit_canonical"))))
    ranked = hits.withColumns({"lexical": lexical, "rank": F.row_number().over(order), "best": F.max("score").over(all_)})
    # runners-up are close as long as none before them is not: they come in order of score
    close = F.sum(((F.col("rank") > 1) & (F.col("best") - F.col("score") <= cfg.close_candidate_delta)).cast("int")).over(all_)
    second = F.max(F.when(F.col("rank") == 2, F.col("score"))).over(all_)
    shown = F.struct("rank", F.col("hit"), F.col("score"), F.col("hit_canonical").alias("canonical"), F.col("lexical"))
    runners = F.array_sort(F.collect_list(F.when((F.col("rank") > 1) & (F.col("rank") <= cfg.review_max_candidates), shown)).over(all_))
    top = ranked.withColumns({"close": close, "second": second, "runners_up": runners}).where("rank = 1")
    margin = F.col("best") - F.col("second")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("score") < cfg.auto_merge_threshold, F.lit("below_auto_merge_threshold")),
            F.when(F.coalesce(margin < cfg.min_margin, F.lit(False)), F.lit("insufficient_margin")),
            F.when(F.col("lexical") < cfg.min_lexical_similarity, F.lit("insufficient_lexical")),
            F.when(F.col("close") > cfg.max_close_candidates, F.lit("too_many_close_candidates")),
            F.when(hard_conflict(F.col("props"), F.col("hit_props"), cfg.conflict_properties).isNotNull(), F.lit("hard_conflict")),
            F.when(is_type_only(F.col("canonical")), F.lit("type_only")) if not cfg.allow_type_only_auto_merge else F.lit(None).cast("string"),
        )
    )
    outcome = F.when(F.col("score") < cfg.review_threshold, "none").when(F.size("reasons") == 0, "merge").otherwise("review")
    return top.withColumn("reasons", reasons).withColumn("outcome", outcome).select(*by, "hit", "hit_canonical", "score", "lexical", "outcome", "reasons", "runners_up")


def _close(a: dict, b: dict, names: tuple[str, ...]) -> bool:
    return any(a.get(n) and b.get(n) and a[n] not in ('""', "null") and b[n] not in ('""', "null") and a[n] != b[n] for n in names)


def _name(canonical: str) -> str:
    rest = []
    for line in canonical.split("\n"):
        key, colon, value = line.partition(":")
        if key == "name" and value.strip():
            return value.strip()
        if line.strip() and key != "type":
            rest.append(value.strip() if colon else line.strip())
    return rest[0] if rest else ""


def cluster(pdf: pd.DataFrame, cfg: ResolveConfig) -> pd.DataFrame:
    """Greedy clustering of one type's candidates in their order: the key each one takes, and what is to review."""
    pdf = pdf.sort_values("idx")
    reps: list[int] = []
    rows, vecs = pdf.to_dict("records"), np.array(pdf["vec"].tolist(), float).reshape(len(pdf), -1)
    size = np.linalg.norm(vecs, axis=1)
    out = []
    for i, r in enumerate(rows):
        key, outcome, reasons, hit, score = r["canonical"], "none", [], None, None
        if reps:
            dots = vecs[reps] @ vecs[i]
            both = size[reps] * size[i]
            cos = np.divide(dots, both, out=np.zeros(len(reps)), where=both > 0)
            hits = sorted(((c, j) for c, j in zip(cos.tolist(), reps) if c >= cfg.similarity_threshold), key=lambda x: (-x[0], x[1]))
            if hits and hits[0][0] >= cfg.review_threshold:
                score, j = hits[0]
                hit = rows[j]["idx"]
                if score < cfg.auto_merge_threshold:
                    reasons.append("below_auto_merge_threshold")
                if len(hits) > 1 and score - hits[1][0] < cfg.min_margin:
                    reasons.append("insufficient_margin")
                if jaro(_name(r["canonical"]).lower(), _name(rows[j]["canonical"]).lower()) < cfg.min_lexical_similarity:
                    reasons.append("insufficient_lexical")
                if sum(score - c <= cfg.close_candidate_delta for c, _ in hits[1:]) > cfg.max_close_candidates:
                    reasons.append("too_many_close_candidates")
                if _close(dict(r["props"]), dict(rows[j]["props"]), cfg.conflict_properties):
                    reasons.append("hard_conflict")
                lines = [x for x in r["canonical"].split("\n") if x.strip()]
                if not cfg.allow_type_only_auto_merge and len(lines) == 1 and lines[0].startswith("type: "):
                    reasons.append("type_only")
                outcome = "review" if reasons else "merge"
                if outcome == "merge":
                    key = rows[j]["canonical"]
        if outcome != "merge":
            reps.append(i)
        out.append((r["idx"], key, outcome, hit, score, reasons))
    return pd.DataFrame(out, columns=["idx", "new_key", "outcome", "hit", "score", "reasons"])


class Resolver:
    """Gives soft entities of a batch the keys of what they are the same as."""

    def __init__(self, embedder: Embedder | None, cfg: ResolveConfig | None = None):
        self.embedder, self.cfg = embedder, cfg or ResolveConfig()

    def resolve(self, entities: DataFrame, store: Any) -> tuple[DataFrame, dict]:
        soft = entities.where(F.col("soft") & (F.col("key") != "") & F.col("props").isNotNull())
        if soft.isEmpty():
            return entities, {}
        if self.embedder is None:
            raise IngestError("soft keys need an embedder")
        cfg = self.cfg
        cands = soft.select("idx", "type", F.col("key").alias("canonical"), "props", self.embedder.column(F.col("key")).alias("vec"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return cluster(pdf, cfg)

        inside = cands.groupBy("type").applyInPandas(run, "idx long, new_key string, outcome string, hit long, score double, reasons array<string>")
        first = inside.where("outcome <> 'merge'").join(cands, "idx")
        known = store.nodes().where(F.col("key_field") == CANONICAL).select(
            F.col("nid").alias("hit"), F.col("type").alias("hit_type"), F.col("key").alias("hit_canonical"), F.col("props").alias("hit_props"),
            self.embedder.column(F.col("key")).alias("hit_vec"),
        )
        near = first.drop("hit", "score", "outcome", "reasons").join(known, F.col("type") == F.col("hit_type"))
        near = near.withColumn("score", cosine(F.col("vec"), F.col("hit_vec"))).where(F.col("score") >= cfg.similarity_threshold)
        rank = Window.partitionBy("idx").orderBy(F.desc("score"), "hit")
        near = near.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= cfg.candidate_k).drop("r", "vec", "hit_vec", "hit_type")
        found = gates(near, cfg)
        taken = found.where("outcome = 'merge'").select("idx", F.col("hit_canonical").alias("stored_key"))
        # what merged in the batch follows its representative
        reps = inside.select("idx", "new_key").join(cands.select(F.col("idx").alias("rep"), F.col("canonical").alias("new_key")), "new_key")
        reps = reps.groupBy("idx", "new_key").agg(F.min("rep").alias("rep"))
        final = reps.join(taken.withColumnRenamed("idx", "rep"), "rep", "left").select("idx", F.coalesce("stored_key", "new_key").alias("final_key"))
        out = entities.join(final, "idx", "left")
        key = F.coalesce("final_key", "key")
        quoted = F.regexp_extract(F.to_json(F.struct(F.col("final_key").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        props = F.when(
            F.col("final_key").isNotNull() & (F.col("final_key") != F.col("key")),
            F.map_concat(F.map_filter("props", lambda k, v: k != CANONICAL), F.create_map(F.lit(CANONICAL), quoted)),
        ).otherwise(F.col("props"))
        resolved = out.withColumns({"props": props, "key": key}).select(*entities.columns)
        review = inside.where("outcome = 'review'").select("idx", F.lit("in_batch").alias("place"), "hit", "score", "reasons").union(
            found.where("outcome = 'review'").select("idx", F.lit("existing"), "hit", "score", "reasons")
        )
        # as many as a batch has: written beside the graph, not sent to the driver
        path = f"{store.path}/reviews/{uuid.uuid4().hex}"
        review.write.parquet(path)
        report = {
            "collapsed_in_batch": inside.where("outcome = 'merge'").count(),
            "merged_with_stored": taken.count(),
            "reviews": entities.sparkSession.read.schema(review.schema).parquet(path),
        }
        return resolved, report
