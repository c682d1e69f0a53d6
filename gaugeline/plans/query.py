"""The query language: a conjunction of filters with order, paging, grouping and aggregate hints."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from .. import schema

MULTI = {"equal", "contains", "containsAny", "notContains"}
COMPARISONS = {"lessThan", "lessThanEqual", "greaterThan", "greaterThanEqual"}
FILTERS = MULTI | COMPARISONS | {"notEqual", "between", "notBetween", "isNull", "isNotNull", "startsWith", "endsWith"}
#: Bucket sizes of grouped reads, by the token that names them.
INTERVALS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "1h": "hour", "1d": "day", "1w": "week", "1M": "month"}


@dataclass(frozen=True)
class Query:
    """One clause. Use the factories below rather than the constructor."""

    method: str
    attribute: str = ""
    values: tuple = ()


def _many(values) -> tuple:
    return tuple(values) if isinstance(values, list | tuple | set | frozenset) else (values,)


def equal(attribute: str, values) -> Query:
    return Query("equal", attribute, _many(values))


def not_equal(attribute: str, values) -> Query:
    return Query("notEqual", attribute, _many(values))


def less_than(attribute: str, value) -> Query:
    return Query("lessThan", attribute, (value,))


def less_than_equal(attribute: str, value) -> Query:
    return Query("lessThanEqual", attribute, (value,))


def greater_than(attribute: str, value) -> Query:
    return Query("greaterThan", attribute, (value,))


def greater_than_equal(attribute: str, value) -> Query:
    return Query("greaterThanEqual", attribute, (value,))


def between(attribute: str, low, high) -> Query:
    return Query("between", attribute, (low, high))


def not_between(attribute: str, low, high) -> Query:
    return Query("notBetween", attribute, (low, high))


def is_null(attribute: str) -> Query:
    return Query("isNull", attribute)


def is_not_null(attribute: str) -> Query:
    return Query("isNotNull", attribute)


def contains(attribute: str, needles) -> Query:
    return Query("contains", attribute, _many(needles))


def contains_any(attribute: str, needles) -> Query:
    return Query("containsAny", attribute, _many(needles))


contains_string = contains


def not_contains(attribute: str, needles) -> Query:
    return Query("notContains", attribute, _many(needles))


def starts_with(attribute: str, needle: str) -> Query:
    return Query("startsWith", attribute, (needle,))


def ends_with(attribute: str, needle: str) -> Query:
    return Query("endsWith", attribute, (needle,))


def order_asc(attribute: str) -> Query:
    return Query("orderAsc", attribute)


def order_desc(attribute: str) -> Query:
    return Query("orderDesc", attribute)


def limit(n: int) -> Query:
    return Query("limit", "", (n,))


def offset(n: int) -> Query:
    return Query("offset", "", (n,))


def cursor_after(row: Mapping | None) -> Query:
    return Query("cursorAfter", "", (row,))


def cursor_before(row: Mapping | None) -> Query:
    return Query("cursorBefore", "", (row,))


def group_by_interval(interval: str) -> Query:
    if interval not in INTERVALS:
        raise ValueError(f"Invalid interval '{interval}'. Allowed: {', '.join(INTERVALS)}")
    return Query("groupByInterval", "time", (interval,))


def group_by(dimension: str) -> Query:
    if not dimension:
        raise ValueError("group_by needs a dimension")
    return Query("groupBy", dimension)


def aggregate(function: str) -> Query:
    if function != "max":
        raise ValueError(f"Invalid aggregate '{function}'. Allowed: max")
    return Query("aggregate", "value", (function,))


def utc(value: Any) -> datetime:
    """A time literal as a naive datetime in UTC; offsets are converted, microseconds kept."""
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.strip())
        except ValueError:
            raise ValueError(f"Invalid time '{value}'") from None
    if not isinstance(value, datetime):
        raise TypeError(f"Time must be a datetime or a string, got {type(value).__name__}")
    return value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value


@dataclass(frozen=True)
class Spec:
    """A parsed list of clauses."""

    filters: tuple[Query, ...] = ()
    orders: tuple[tuple[str, bool], ...] = ()  # (attribute, descending)
    limit: int | None = None
    offset: int | None = None
    interval: str | None = None
    dims: tuple[str, ...] = ()
    aggregate: str | None = None
    cursor: Mapping | None = field(default=None, hash=False)
    before: bool = False

    @property
    def grouped(self) -> bool:
        return bool(self.interval or self.dims or self.aggregate)

    @property
    def referenced(self) -> set[str]:
        return {q.attribute for q in self.filters} | {a for a, _ in self.orders if not self.grouped or a not in ("value", "time", "bucket", "metric")} | set(self.dims)


def _whole(q: Query) -> int:
    n = q.values[0] if q.values else None
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise ValueError(f"{q.method} takes an integer from 0 on")
    return n


def parse(queries: Iterable[Query]) -> Spec:
    """Sort clauses into a Spec; checks what doesn't depend on the table."""
    s: dict[str, Any] = {"filters": [], "orders": [], "dims": []}
    for q in queries:
        if not isinstance(q, Query):
            raise TypeError(f"Expected a Query, got {type(q).__name__}")
        m = q.method
        if m in FILTERS:
            if m not in ("isNull", "isNotNull") and not q.values:
                raise ValueError(f"{m} needs a value")
            s["filters"].append(q)
        elif m in ("orderAsc", "orderDesc"):
            s["orders"].append((q.attribute, m == "orderDesc"))
        elif m in ("limit", "offset"):
            s[m] = _whole(q)
        elif m in ("cursorAfter", "cursorBefore"):
            if q.values[0] is not None and "cursor" not in s:
                s["cursor"], s["before"] = cursor_row(q.values[0]), m == "cursorBefore"
        elif m == "groupByInterval":
            s["interval"] = q.values[0]
        elif m == "groupBy":
            if q.attribute not in s["dims"]:
                s["dims"].append(q.attribute)
        elif m == "aggregate":
            s["aggregate"] = q.values[0]
        else:
            raise ValueError(f"Unsupported query method '{m}'")
    spec = Spec(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items()})
    if spec.cursor is not None and spec.grouped:
        raise ValueError("Grouped results have no cursor")
    return spec


def cursor_row(row: Any) -> dict:
    if hasattr(row, "asDict"):
        row = row.asDict()
    if not isinstance(row, Mapping):
        raise TypeError(f"A cursor is a row or a mapping, not {type(row).__name__}")
    out = dict(row)
    if "id" not in out and "$id" in out:
        out["id"] = out.pop("$id")
    return out


def applies(spec: Spec, kind: str) -> bool:
    """Whether a table of this type has every attribute that the clauses name."""
    return spec.referenced <= schema.attributes(kind)


def check(spec: Spec, kind: str) -> None:
    known = schema.attributes(kind)
    for name in sorted(spec.referenced):
        if name not in known:
            raise ValueError(f"Invalid attribute name: {name}" + (f" (events only; not in {kind}s)" if name in schema.EVENT_DIMS else ""))
    for d in spec.dims:
        if d not in schema.dims(kind) and d != "tenant":
            raise ValueError(f"Invalid groupBy dimension '{d}' for {kind}s")
    if spec.grouped:
        have = {"metric", "value", *spec.dims} | ({"time", "bucket"} if spec.interval else set())
        for a, _ in spec.orders:
            if a == "time" and not spec.interval:
                raise ValueError("Without an interval a grouped result has no time to order by")
            if a not in have:
                raise ValueError(f"Cannot order a grouped result by '{a}'")
