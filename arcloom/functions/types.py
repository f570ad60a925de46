"""Field types: what a typed filter means and how a raw value is stored.

A handler gives a predicate on a Column for the operators it has, and parses
raw values at ingest.  The registry is open: the last registration of a name
wins, and `TypeHandler` is all that a new type has to provide.
"""

from __future__ import annotations

import datetime as dt
import enum
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FieldTypeError
from .scalars import normalized

#: Names under which an ontology or a document may give a storage type.
STORAGE_ALIASES = {
    "keyword": "Keyword", "string": "Keyword", "text": "Text", "semantictext": "Text", "number": "Number", "int": "Number", "integer": "Number",
    "float": "Number", "bool": "Bool", "boolean": "Bool", "datetime": "Datetime", "date": "Datetime", "timestamp": "Datetime", "list": "List",
}
#: Storage type to the handler that parses it at ingest, and to the one of its filters (None: plain comparison).
INGEST_HANDLER = {"Keyword": "Keyword", "Text": "SemanticText", "Number": "Number", "Bool": "Boolean", "Datetime": "Timestamp", "List": "List"}
QUERY_HANDLER = {"Keyword": "Keyword", "Text": "SemanticText", "Number": None, "Bool": None, "Datetime": "Timestamp", "List": "List"}

TYPED_OPS = {
    "eq", "neq", "gt", "gte", "lt", "lte", "in", "contains", "starts_with", "ends_with", "matches", "search", "search_reranked", "hybrid_search",
}
_OP_ALIASES = {"regex": "matches", "hybrid": "hybrid_search"}


def storage_type(name: str) -> str:
    got = STORAGE_ALIASES.get(name.lower())
    if got is None:
        raise FieldTypeError(f"unknown property type {name!r}")
    return got


def typed_op(op: str) -> str:
    op = _OP_ALIASES.get(op, op)
    if op not in TYPED_OPS:
        raise FieldTypeError(f"{op!r} is no operator of typed fields")
    return op


class Capability(enum.Flag):
    NONE = 0
    EQUALITY = enum.auto()
    ORDER = enum.auto()
    MEMBERSHIP = enum.auto()
    SUBSTRING = enum.auto()
    REGEX = enum.auto()
    SEMANTIC = enum.auto()

    def ops(self) -> list[str]:
        table = {
            Capability.EQUALITY: ["eq", "neq"], Capability.ORDER: ["gt", "gte", "lt", "lte"], Capability.MEMBERSHIP: ["in"],
            Capability.SUBSTRING: ["contains", "starts_with", "ends_with"], Capability.REGEX: ["matches"],
            Capability.SEMANTIC: ["search", "search_reranked", "hybrid_search"],
        }
        return [op for c, ops in table.items() if c in self for op in ops]


@dataclass(frozen=True)
class Contribution:
    """What a handler may add to a plan beside or instead of a predicate."""

    #: Rows (nid, and score if it has one) that the filtered alias is joined to.
    hits: DataFrame | None = None
    predicate: Column | None = None
    #: Sort keys after the query's own; unused when it aggregates.
    order: tuple[Column, ...] = ()


class TypeHandler(Protocol):
    """A field type. A handler may also have `contribute(field, kind, op, value) -> Contribution`, which then replaces `predicate`."""

    type_id: str
    capabilities: Capability

    def supported_ops(self) -> list[str]: ...

    def predicate(self, c: Column, kind: T.DataType, op: str, value: Any) -> Column: ...

    def parse(self, raw: Any) -> Any: ...

    def prompt_hint(self) -> str: ...


def scalar_operand(v: Any) -> Any:
    """A JSON value as an operand: finite scalars and lists of them."""
    if isinstance(v, dict):
        raise FieldTypeError("an object is no operand")
    if isinstance(v, float) and not math.isfinite(v):
        raise FieldTypeError("an operand must be finite")
    if isinstance(v, list):
        return [scalar_operand(x) for x in v]
    return v


def _text(v: Any) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    return v if isinstance(v, str) else str(v)


class _Base:
    type_id = ""
    capabilities = Capability.NONE

    def supported_ops(self) -> list[str]:
        return self.capabilities.ops()

    def prompt_hint(self) -> str:
        return f"{self.type_id}: " + ", ".join(self.supported_ops())

    def _check(self, op: str) -> None:
        if op not in self.supported_ops():
            raise FieldTypeError(f"{self.type_id} has no operator {op!r}")


class Keyword(_Base):
    """Exact words: matched without regard to case and outer space, ordered and matched by pattern as they are."""

    type_id = "Keyword"
    capabilities = Capability.EQUALITY | Capability.ORDER | Capability.MEMBERSHIP | Capability.SUBSTRING | Capability.REGEX

    def predicate(self, c: Column, kind: T.DataType, op: str, value: Any) -> Column:
        self._check(op)
        value = scalar_operand(value)
        c = c.cast("string")
        if op == "in":
            if not isinstance(value, list):
                raise FieldTypeError("in takes a list")
            return normalized(c).isin([_text(v).strip().lower() for v in value]) if value else F.lit(False)
        if isinstance(value, list) or value is None:
            raise FieldTypeError(f"{op} takes a scalar")
        raw = F.lit(_text(value))
        if op in ("gt", "gte", "lt", "lte"):
            return {"gt": c > raw, "gte": c >= raw, "lt": c < raw, "lte": c <= raw}[op]
        if op == "matches":
            return F.rlike(c, F.lit(rf"\A(?:{_text(value)})\z"))
        n, v = normalized(c), F.lit(_text(value).strip().lower())
        return {"eq": n == v, "neq": n != v, "contains": F.contains(n, v), "starts_with": F.startswith(n, v), "ends_with": F.endswith(n, v)}[op]

    def parse(self, raw: Any) -> Any:
        if raw is None:
            return None
        if isinstance(raw, dict):
            raise FieldTypeError("Keyword rejects an object")
        if isinstance(raw, list):
            return [self.parse(x) for x in raw if x is not None]
        return _text(raw)


class Number(_Base):
    type_id = "Number"
    capabilities = Capability.EQUALITY | Capability.ORDER | Capability.MEMBERSHIP

    def predicate(self, c: Column, kind: T.DataType, op: str, value: Any) -> Column:
        self._check(op)
        if op == "in":
            values = [self.parse(v) for v in value]
            return c.isin(values) if values else F.lit(False)
        v = F.lit(self.parse(value))
        return {"eq": c == v, "neq": c != v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]

    def parse(self, raw: Any) -> Any:
        if raw is None:
            return None
        if isinstance(raw, bool) or isinstance(raw, dict):
            raise FieldTypeError(f"Number rejects {raw!r}")
        if isinstance(raw, list):
            return [self.parse(x) for x in raw]
        if isinstance(raw, (int, float)):
            if isinstance(raw, float) and not math.isfinite(raw):
                raise FieldTypeError("Number must be finite")
            return raw
        s = raw.strip().replace(",", "").replace("_", "")
        if not s:
            return 0
        percent = s.endswith("%")
        s = s[:-1].strip() if percent else s
        try:
            got: float | int = int(s) if re.fullmatch(r"[+-]?\d+", s) and not percent else float(s)
        except ValueError:
            raise FieldTypeError(f"{raw!r} is no number") from None
        if isinstance(got, float) and not math.isfinite(got):
            raise FieldTypeError("Number must be finite")
        return got / 100 if percent else got


class Boolean(_Base):
    type_id = "Boolean"
    capabilities = Capability.EQUALITY

    def predicate(self, c: Column, kind: T.DataType, op: str, value: Any) -> Column:
        self._check(op)
        v = F.lit(self.parse(value))
        return c == v if op == "eq" else c != v

    def parse(self, raw: Any) -> Any:
        if raw is None or isinstance(raw, bool):
            return raw
        if isinstance(raw, str):
            s = raw.strip().lower()
            if s in ("true", "yes", "y", "1", "on"):
                return True
            if s in ("false", "no", "n", "0", "off"):
                return False
        raise FieldTypeError(f"{raw!r} is no boolean")


_TIME = re.compile(r"(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?\Z")
_ZONE = re.compile(r"(?:[Zz]|[+-]\d{2}:?\d{2})\Z")


def _date(s: str) -> dt.date:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", s):
        raise FieldTypeError(f"{s!r} is no YYYY-MM-DD date")
    try:
        return dt.date.fromisoformat(s)
    except ValueError as e:
        raise FieldTypeError(str(e)) from None


def _split(s: str) -> tuple[dt.date, str, str]:
    """Date, time of day (perhaps empty) and zone (perhaps empty) of an ISO text."""
    s = s.strip()
    day = _date(s[:10])
    rest = s[10:]
    if not rest:
        return day, "", ""
    if rest[0] not in "T ":
        raise FieldTypeError(f"{s!r} is no date or date-time")
    rest = rest[1:]
    m = _ZONE.search(rest)
    zone = m.group(0) if m else ""
    body = rest[: len(rest) - len(zone)]
    t = _TIME.match(body)
    if not t or int(t[1]) > 23 or int(t[2]) > 59 or int(t[3] or 0) > 59:
        raise FieldTypeError(f"{body!r} is no time of day")
    if zone and zone not in "Zz" and (int(zone[1:3]) > 23 or int(zone[-2:]) > 59):
        raise FieldTypeError(f"{zone!r} is no offset")
    return day, body, zone


class _Temporal(_Base):
    """Operands on midnight, or without a time, stand for the whole day; others for the instant. Civil time throughout."""

    capabilities = Capability.EQUALITY | Capability.ORDER

    @staticmethod
    def operand(value: Any) -> tuple[dt.datetime, bool]:
        """The civil moment, and whether it stands for its day."""
        if isinstance(value, bool) or not isinstance(value, (str, int, float)):
            raise FieldTypeError(f"{value!r} is no date or time")
        if isinstance(value, (int, float)):
            try:
                at = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(value))
            except OverflowError:
                raise FieldTypeError(f"{value!r} is out of range") from None
        else:
            day, body, _ = _split(value)
            t = _TIME.match(body) if body else None
            at = dt.datetime.combine(day, dt.time(int(t[1]), int(t[2]), int(t[3] or 0), int(((t[4] or "") + "000000")[:6])) if t else dt.time())
        return at, at.time() == dt.time()

    @staticmethod
    def civil(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            # ISO text keeps its civil parts whatever its zone
            return F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(F.trim(c), r"([Zz]|[+-]\d{2}:?\d{2})$", ""), " ", "T").try_cast("timestamp_ntz").cast("string"))
        if isinstance(kind, (T.IntegerType, T.LongType)):
            return F.timestamp_seconds(c).cast("timestamp_ntz")
        return c.cast("timestamp_ntz")

    def predicate(self, c: Column, kind: T.DataType, op: str, value: Any) -> Column:
        self._check(op)
        at, whole = self.operand(value)
        # comparing a column with literals of its own type lets the bounds reach the scan
        if isinstance(kind, T.TimestampType):
            x, lit = c, lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp")
        else:
            x, lit = self.civil(c, kind), lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
        low = lit(at)
        if not whole:
            return {"eq": x == low, "neq": x != low, "gt": x > low, "gte": x >= low, "lt": x < low, "lte": x <= low}[op]
        high = lit(at + dt.timedelta(days=1))
        return {
            "eq": (x >= low) & (x < high), "neq": (x < low) | (x >= high), "gt": x >= high, "gte": x >= low, "lt": x < low, "lte": x < high,
        }[op]


class Date(_Temporal):
    type_id = "Date"

    def parse(self, raw: Any) -> Any:
        if raw is None:
            return None
        if isinstance(raw, list):
            return [self.parse(x) for x in raw]
        if isinstance(raw, str):
            return _split(raw)[0].isoformat()
        return self.operand(raw)[0].date().isoformat()


class Timestamp(_Temporal):
    type_id = "Timestamp"

    def parse(self, raw: Any) -> Any:
        if raw is None:
            return None
        if isinstance(raw, list):
            return [self.parse(x) for x in raw]
        if not isinstance(raw, str):
            return self.operand(raw)[0].isoformat() + "Z"
        day, body, zone = _split(raw)
        if not body:
            return f"{day.isoformat()}T00:00:00Z"
        if body.count(":") == 1:
            body += ":00"
        return f"{day.isoformat()}T{body}{zone or 'Z'}"


class ListType(_Base):
    """A list: contains is true if any element has the operand in it, without regard to case."""

    type_id = "List"
    capabilities = Capability.NONE

    def supported_ops(self) -> list[str]:
        return ["contains"]

    def predicate(self, c: Column, kind: T.DataType, op: str, value: Any) -> Column:
        self._check(op)
        if isinstance(value, (list, dict)) or value is None:
            raise FieldTypeError("contains takes a scalar")
        v = F.lit(_text(value).strip().lower())
        if not isinstance(kind, T.ArrayType):
            return F.contains(normalized(c.cast("string")), v)
        return F.exists(c, lambda x: F.contains(F.lower(x.cast("string")), v))

    def parse(self, raw: Any) -> Any:
        got = Keyword().parse(raw)
        return got if got is None or isinstance(got, list) else [got]


class SemanticText(_Base):
    """Text found by search; its filters are folded into one retrieval per alias by the planner."""

    type_id = "SemanticText"
    capabilities = Capability.EQUALITY | Capability.MEMBERSHIP | Capability.SEMANTIC

    def supported_ops(self) -> list[str]:
        return ["eq", "neq", "in", "contains", "search", "search_reranked", "hybrid_search"]

    def predicate(self, c: Column, kind: T.DataType, op: str, value: Any) -> Column:
        raise FieldTypeError("text filters are planned as a retrieval")

    def parse(self, raw: Any) -> Any:
        if raw is None or isinstance(raw, str):
            return raw
        raise FieldTypeError(f"SemanticText rejects {raw!r}")


class Registry:
    def __init__(self) -> None:
        self._handlers: dict[str, TypeHandler] = {}
        for h in (Keyword(), Number(), Boolean(), Date(), Timestamp(), ListType(), SemanticText()):
            self.register(h)

    def register(self, handler: TypeHandler) -> None:
        self._handlers[handler.type_id] = handler

    def get(self, type_id: str) -> TypeHandler:
        if type_id in self._handlers:
            return self._handlers[type_id]
        alias = STORAGE_ALIASES.get(type_id.lower())
        if alias is not None:
            return self._handlers[INGEST_HANDLER[alias]]
        raise FieldTypeError(f"unknown type {type_id!r}")

    def names(self) -> list[str]:
        return sorted(self._handlers)


def plain_predicate(c: Column, kind: T.DataType, op: str, value: Any) -> Column:
    """An untyped comparison: exact, and null where column and operand are of different sorts."""
    value = scalar_operand(value)
    ci = op.endswith("_ci")
    base = op[:-3] if ci else op
    text = isinstance(kind, T.StringType)
    null = F.lit(None).cast("boolean")
    if base == "in":
        if not isinstance(value, list):
            raise FieldTypeError("in takes a list")
        fit = [v for v in value if _fits(kind, v)]
        if ci:
            return normalized(c).isin([_text(v).strip().lower() for v in value]) if text and value else F.lit(False) if text else null
        return c.isin(fit) if fit else F.when(c.isNotNull(), F.lit(False))
    if isinstance(value, list):
        if base in ("eq", "neq") and isinstance(kind, T.ArrayType):
            same = c == F.array(*[F.lit(v) for v in value])
            return same if base == "eq" else ~same
        raise FieldTypeError(f"{op} takes a scalar")
    if base in ("contains", "starts_with", "ends_with") or ci:
        if not text:
            return null
        left, right = (normalized(c), F.lit(_text(value).strip().lower())) if ci else (c, F.lit(_text(value)))
        table: dict[str, Callable[[], Column]] = {
            "contains": lambda: F.contains(left, right), "starts_with": lambda: F.startswith(left, right), "ends_with": lambda: F.endswith(left, right),
            "eq": lambda: left == right, "neq": lambda: left != right,
        }
        if base not in table:
            raise FieldTypeError(f"unknown operator {op!r}")
        return table[base]()
    if value is None:
        return null
    if not _fits(kind, value):
        # values of another sort are never equal, and are not ordered
        return F.when(c.isNotNull(), F.lit(base == "neq")) if base in ("eq", "neq") else null
    v = F.lit(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        v = F.lit(value).cast(kind)
    return {"eq": c == v, "neq": c != v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[base]


def _fits(kind: T.DataType, v: Any) -> bool:
    if isinstance(v, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(v, (int, float)):
        return isinstance(kind, T.NumericType)
    return isinstance(kind, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType))
