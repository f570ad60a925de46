"""Scalar functions of the query language, as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalized(c: Column) -> Column:
    """The form in which case-insensitive predicates compare: trimmed, lower case."""
    return F.lower(F.trim(c))


def date_part(c: Column, kind: T.DataType, part: str) -> Column:
    """year, quarter, month, day or hour.

    Of text the ISO form is read by position, and text that is too short has no
    part; a date has no hour.
    """
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "hour": F.hour}[part](c)
    if isinstance(kind, T.DateType):
        if part == "hour":
            return F.lit(None).cast("int")
        return {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth}[part](c)
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("int")

    def cut(begin: int, n: int) -> Column:
        return F.when(F.length(c) >= begin + n - 1, F.substring(c, begin, n).try_cast("int"))

    if part == "quarter":
        return F.ceil(cut(6, 2) / 3).cast("int")
    return {"year": cut(1, 4), "month": cut(6, 2), "day": cut(9, 2), "hour": cut(12, 2)}[part]


def sentences(c: Column) -> Column:
    """Parts of a text after each of . ! ?, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def canonical_text(entity_type: Column, props: Column) -> Column:
    """`type: T` and one `key: value` line per entry of a map<string,string>, by key; null values are left out."""
    entries = F.filter(F.array_sort(F.map_entries(props)), lambda e: e["value"].isNotNull())
    lines = F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.concat(F.array(F.concat(F.lit("type: "), entity_type)), lines), "\n")


def primary_name(canonical: Column) -> Column:
    """The value of the `name:` line, else of the first line that is not `type:`, else the empty text."""
    lines = F.split(canonical, "\n")
    named = F.regexp_extract(canonical, r"(?m)^name:[ \t]*(.*)$", 1)
    others = F.filter(lines, lambda x: ~F.startswith(x, F.lit("type:")) & (F.trim(x) != ""))
    first = F.regexp_replace(F.get(others, F.lit(0)), r"^[^:]*:[ \t]*", "")
    return F.trim(F.coalesce(F.when(named != "", named), first, F.lit("")))


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity: prefix of up to 4 at 0.1, always applied; two empty texts have 0; null with null."""
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def iso_epoch(c: Column) -> Column:
    """Epoch seconds of an ISO date or date-time text (no zone: UTC), or null."""
    text = F.trim(c)
    return F.unix_timestamp(F.coalesce(F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX")), F.try_to_timestamp(text)))
