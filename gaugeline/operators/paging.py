"""Pages in order of time, from as few months as they need.

All rows of a month come before those of the next. So if the first months of an order hold as many matching rows as a
page and what it skips, the page is in them, whatever the months after them hold. Months are taken in order, one
first, then twice as many each time, and of each only the count of matching rows is asked, up to what is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import after_cursor
from ..plans.query import Spec, check, utc
from ..plans.window import TICK, reduce_window
from .reads import cursor_orders, filtered


def months_of_page(df: DataFrame, kind: str, tenant: str | None, spec: Spec, months: list[str]) -> list[str] | None:
    """The months that the page needs, or None where its order or limit allows no choice."""
    if spec.limit is None or not spec.orders or spec.orders[0][0] != "time" or "month" not in df.columns:
        return None
    check(spec, kind)
    backwards = spec.orders[0][1] != bool(spec.cursor is not None and spec.before)
    reduced = reduce_window(spec.filters)
    lo, hi = (reduced[0].lo, reduced[0].hi) if reduced else (None, None)
    more = []
    if spec.cursor is not None:
        more = [after_cursor(cursor_orders(spec), spec.cursor, spec.before)]
        at = utc(spec.cursor["time"])
        lo, hi = (lo, at + TICK if hi is None else min(hi, at + TICK)) if backwards else (at if lo is None else max(lo, at), hi)
    left = [m for m in sorted(months, reverse=backwards) if (lo is None or m >= f"{lo:%Y-%m}") and (hi is None or m <= f"{hi - TICK:%Y-%m}")]
    need, taken, step = spec.limit + (spec.offset or 0), [], 1
    while left and need > 0:
        some, left = left[:step], left[step:]
        taken += some
        if not left:
            break
        found = filtered(df, tenant, spec, None, *more, F.col("month").isin(some)).limit(need)
        need -= found.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        step *= 2
    return taken


def paged(df: DataFrame, kind: str, tenant: str | None, spec: Spec, months: list[str]) -> DataFrame:
    """df with no more months than the page needs."""
    needed = months_of_page(df, kind, tenant, spec, months) if len(months) > 2 else None
    return df if needed is None else df.where(F.col("month").isin(needed))
