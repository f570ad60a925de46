"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash of their id and text.  A document's
virtual finish time is the tokens of its source up to and with it, divided by
the source's weight; in the order of these times each source advances in
proportion to its weight until it runs out.  The order is cut where the tokens
of all documents before it reach the budget.

Cumulative sums are made without a window over a source: the hash cuts each
source into even buckets, bucket totals give each bucket its start, and the
window is within a bucket.  The cut is found by cutting the range of times into
bins, summing tokens by bin and looking again within the one bin that crosses
the budget, until it holds few documents; so no total order is needed before
the last range sort of what is kept.  Bucket and bin numbers change nothing in
the result.

Tokens are the runs of non-space characters. Defined cases: null text and text
without any are 0 tokens and take their place in the order. A null source is a
source of its own. Sources without a weight have weight 1; those of weight 0 or
less are left out. Null ids are shuffled as the empty text. Ties in the hash go by id, then
tokens. Rows alike in id, source and text count each, with finish times of their
own; as many as fit are in. A document that would pass the budget ends the mix.
Extra columns are kept by `mix` and ignored by `schedule`. Empty
tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, hidden, written

#: Target weights of the production mix, against 1 for every other source.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}
#: Share of the corpus's tokens that is the budget, unless a number of tokens is given.
SHARE = 0.6
SEED = "mix-1"
#: Documents in a bucket or in the last bin, about.
BUCKET_ROWS = 20_000
BINS = 4096


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _key(doc_id: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"/{seed}/"), F.coalesce(text, F.lit(""))))


def _weight(source: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    if weights:
        table = F.create_map(*[F.lit(x) for item in weights.items() for x in (item[0], float(item[1]))])
        out = F.coalesce(F.element_at(table, source), F.lit(1.0))
    return out


def _timed(thin: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """thin (source, key, doc_id, tokens, copies), a row for each copy from 1 on, with virtual finish times as vft; sources of no weight are gone.

    start is the tokens of the source before the first copy.
    """
    rows = thin.count()
    buckets = 1
    while buckets * BUCKET_ROWS < rows:
        buckets *= 2
    # the hash's first 8 digits in order, so buckets follow the shuffled order
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int")
    thin = thin.withColumn("weight", _weight(F.col("source"), weights)).where("weight > 0").withColumns({"bucket": bucket, "sum": F.col("tokens") * F.col("copies")})
    totals = thin.groupBy("source", "bucket").agg(F.sum("sum").alias("sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "tokens").rowsBetween(Window.unboundedPreceding, -1)
    running = thin.withColumn("upto", F.coalesce(F.sum("sum").over(inside), F.lit(0)))
    out = running.join(starts, running["source"].eqNullSafe(starts["s"]) & (running["bucket"] == starts["b"]))
    out = out.withColumns({"start": F.col("begin") + F.col("upto"), "copy": F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))})
    return out.select("source", "key", "doc_id", "tokens", "copy", "start", "weight", _finish(F.col("start"), F.col("copy"), F.col("tokens"), F.col("weight")).alias("vft"))


def _finish(start: Column, copy: Column, tokens: Column, weight: Column) -> Column:
    return (start + copy * tokens) / weight


ORDER = ("vft", "source", "key", "doc_id", "tokens", "copy")


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ORDER]


def _cut(timed: DataFrame, budget: int) -> tuple[float, DataFrame | None]:
    """(time, rows): all rows before time are in, and of the rows at or after it those in rows."""
    low, high, done = None, None, 0
    span = timed.agg(F.min("vft"), F.max("vft")).first()
    if span[0] is None:
        return 0.0, None
    low, high = span[0], span[1]
    while True:
        part = timed.where(F.col("vft").between(low, high))
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            return low, _at_once(part, budget - done)
        bins = part.groupBy(F.least(F.floor((F.col("vft") - low) / width), F.lit(BINS - 1)).cast("int").alias("bin")).agg(
            F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("vft").alias("a"), F.max("vft").alias("z")
        )
        crossed = None
        for r in sorted(bins.collect(), key=lambda r: r["bin"]):  # at most BINS rows
            if done + r["t"] > budget:
                crossed = r
                break
            done += r["t"]
        if crossed is None:
            return float("inf"), None
        low, high = crossed["a"], crossed["z"]
        if crossed["n"] <= BUCKET_ROWS:
            upto = Window.orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)
            last = timed.where(F.col("vft").between(low, high))
            return low, last.withColumn("upto", F.sum("tokens").over(upto)).where(F.col("upto") <= budget - done).drop("upto")


def _at_once(part: DataFrame, left: int) -> DataFrame | None:
    """Which rows of one finish time are within left tokens.

    Of a source, the row that has tokens is the first of its time and the others
    have none, so the source in which it would pass the budget is out, with all
    that follow.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    sums = part.groupBy("source").agg(F.sum("tokens").alias("t")).withColumn("upto", F.sum("t").over(by_source))
    fits = sums.where(F.col("upto") <= left).select(F.col("source").alias("fits"))
    return part.join(fits.hint("merge"), F.col("source").eqNullSafe(F.col("fits")), "left_semi")


def _planned(docs: DataFrame, weights: Mapping[str, float], share: float, budget_tokens: int | None, seed: str) -> DataFrame:
    """Thin rows of the mix, as `_timed` gives them."""
    thin = docs.select("doc_id", "source", tokens_of(F.col("text")).alias("tokens"), _key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    thin = written(thin.groupBy("source", "key", "doc_id", "tokens").agg(F.count("*").alias("copies")), "tokens")
    if budget_tokens is None:
        budget_tokens = int(thin.agg(F.coalesce(F.sum(F.col("tokens") * F.col("copies")), F.lit(0))).first()[0] * share)
    timed = checkpointed(_timed(thin, weights))
    edge, last = _cut(timed, budget_tokens)
    kept = timed.where(F.col("vft") < edge)
    return kept if last is None else kept.unionByName(last)


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, share: float = SHARE, budget_tokens: int | None = None, seed: str = SEED) -> DataFrame:
    """(doc_id, source, tokens, virtual_finish) of the mix, in its order."""
    kept = _planned(docs, WEIGHTS if weights is None else weights, share, budget_tokens, seed)
    return kept.orderBy(*_order()).select("doc_id", "source", "tokens", F.col("vft").alias("virtual_finish"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, share: float = SHARE, budget_tokens: int | None = None, seed: str = SEED) -> DataFrame:
    """docs cut to the mix, in its order, with their columns.

    The plan is made on thin rows; texts move twice, to meet their time and to
    be range-sorted by it.
    """
    kept = _planned(docs, WEIGHTS if weights is None else weights, share, budget_tokens, seed)
    key, tok, num, src, k, t, start, weight, most = hidden(docs, *(f"mix_{x}" for x in ("key", "tokens", "number", "source", "k", "t", "start", "weight", "most")))
    plan = kept.groupBy(F.col("key").alias(k), F.col("tokens").alias(t), F.col("source").alias(src)).agg(
        F.min("start").alias(start), F.min("weight").alias(weight), F.max("copy").alias(most)
    )
    rows = docs.withColumns({key: _key(F.col("doc_id"), F.col("text"), seed), tok: tokens_of(F.col("text"))})
    rows = rows.withColumn(num, F.row_number().over(Window.partitionBy(key, tok, "source").orderBy(key)))
    joined = rows.join(plan.hint("merge"), (F.col(key) == F.col(k)) & (F.col(tok) == F.col(t)) & F.col("source").eqNullSafe(F.col(src))).where(F.col(num) <= F.col(most))
    at = _finish(F.col(start), F.col(num), F.col(tok), F.col(weight))
    return joined.orderBy(at, F.col("source").asc_nulls_first(), key, tok, num).select(*[F.col(f"`{c}`") for c in docs.columns])


def placed(docs: DataFrame, to: str = "position") -> DataFrame:
    """docs, as read from the files of a sorted table, with each row's place in it from 0.

    A sorted table is written file by file, but read in any order: the place is
    the file's rows before it, by the number in its name, and the row's number in
    its file. Null if docs does not come from Parquet files.
    """
    file, row, n, before = hidden(docs, "file_of_row", "row_of_file", "rows_of_file", "rows_before")
    try:
        at = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return docs.withColumn(to, F.lit(None).cast("long"))
    part = F.regexp_extract(F.col(file), r"part-(\d+)[^/]*$", 1)
    in_order = Window.orderBy(F.when(part != "", part.cast("long")), file).rowsBetween(Window.unboundedPreceding, -1)
    files = at.groupBy(file).agg(F.count("*").alias(n)).select(F.col(file).alias("of"), F.coalesce(F.sum(n).over(in_order), F.lit(0)).alias(before))  # a row a file
    return at.join(files, F.col(file) == F.col("of")).withColumn(to, F.col(before) + F.col(row)).select(*[f"`{c}`" for c in docs.columns], to)


def sql(weights: Mapping[str, float] = WEIGHTS, share: float = SHARE, seed: str = SEED) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {float(w)!r}::DOUBLE" for s, w in weights.items())
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS tokens,
           md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/{seed}/' || coalesce(text, '')) AS key,
           CASE source {cases} ELSE 1.0::DOUBLE END AS weight FROM documents),
b AS (SELECT CAST(floor(CAST(coalesce(sum(tokens), 0) AS DOUBLE) * {share}) AS BIGINT) AS budget FROM d),
v AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, tokens ROWS UNBOUNDED PRECEDING) AS DOUBLE) / weight AS vft FROM d WHERE weight > 0),
c AS (SELECT *, sum(tokens) OVER (ORDER BY vft, source NULLS FIRST, key, doc_id NULLS FIRST, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM v)
SELECT doc_id, source, CAST(tokens AS BIGINT) AS tokens, vft AS virtual_finish FROM c, b WHERE upto <= budget
"""
