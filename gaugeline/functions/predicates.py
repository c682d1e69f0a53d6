"""Query clauses as Spark predicates on plain columns, so that they reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from ..plans.query import Query, utc
from ..plans.window import Window


def literal(attribute: str, value) -> Column:
    """value, typed as the column: time, value (an integer) or text."""
    if attribute == "time":
        return F.lit(utc(value).isoformat(sep=" ")).cast("timestamp_ntz")
    if attribute == "value":
        if isinstance(value, bool) or not isinstance(value, int | str):
            raise TypeError(f"'value' must be compared with an integer, got {type(value).__name__}")
        return F.lit(int(value)).cast("bigint")
    return F.lit(value if isinstance(value, str) else str(value))


def predicate(q: Query) -> Column:
    c = F.col(q.attribute)
    v = [literal(q.attribute, x) for x in q.values]
    match q.method:
        case "equal":
            return c.isin(*v) if len(v) > 1 else c == v[0]
        case "notEqual":
            return ~c.isin(*v) if len(v) > 1 else c != v[0]
        case "lessThan":
            return c < v[0]
        case "lessThanEqual":
            return c <= v[0]
        case "greaterThan":
            return c > v[0]
        case "greaterThanEqual":
            return c >= v[0]
        case "between":
            return c.between(v[0], v[1])
        case "notBetween":
            return ~c.between(v[0], v[1])
        case "isNull":
            return c.isNull()
        case "isNotNull":
            return c.isNotNull()
        case "contains" | "containsAny":
            return reduce(or_, [c.contains(x) for x in v])
        case "notContains":
            return reduce(and_, [~c.contains(x) for x in v])
        case "startsWith" | "endsWith":
            if not isinstance(q.values[0], str):
                raise TypeError(f"{q.method} needs a string")
            return c.startswith(v[0]) if q.method == "startsWith" else c.endswith(v[0])
    raise ValueError(f"Unsupported query method '{q.method}'")


def all_of(queries: Iterable[Query]) -> Column | None:
    found = [predicate(q) for q in queries]
    return reduce(and_, found) if found else None


def in_window(w: Window) -> Column | None:
    parts = []
    if w.lo is not None:
        parts.append(F.col("time") >= literal("time", w.lo))
    if w.hi is not None:
        parts.append(F.col("time") < literal("time", w.hi))
    return reduce(and_, parts) if parts else None


def check_tenant(tenant: str | None) -> None:
    if tenant is not None and (not isinstance(tenant, str) or tenant == ""):
        raise ValueError("Tenant must be a non-empty string")


def after_cursor(orders: list[tuple[str, bool]], cursor: dict, before: bool) -> Column:
    """Rows that follow (or precede) the cursor's row in the order: one comparison for each prefix of it.

    Nulls come last in either direction, so they follow every value, and every value precedes them.
    """
    for a, _ in orders:
        if a not in cursor:
            raise ValueError(f"The cursor lacks a value for '{a}'")
        if cursor[a] is None and a not in schema.NULLABLE:
            raise ValueError(f"The cursor has a null for '{a}', which is never null")
    alternatives = []
    for i, (attribute, descending) in enumerate(orders):
        same = [F.col(a).isNull() if cursor[a] is None else F.col(a) == literal(a, cursor[a]) for a, _ in orders[:i]]
        c = F.col(attribute)
        if cursor[attribute] is None:
            step = c.isNotNull() if before else F.lit(False)
        else:
            v = literal(attribute, cursor[attribute])
            step = (c < v) if descending != before else (c > v)
            step = step if before or attribute not in schema.NULLABLE else step | c.isNull()
        alternatives.append(reduce(and_, [*same, step]))
    return reduce(or_, alternatives)
