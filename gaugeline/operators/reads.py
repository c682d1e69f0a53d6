"""Reads as DataFrames: rows, grouped aggregates, counts and totals."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.buckets import bucket
from ..functions.predicates import after_cursor, all_of, check_tenant, in_window
from ..plans.query import Spec, check
from ..plans.window import TICK, Window, reduce_window


def filtered(df: DataFrame, tenant: str | None, spec: Spec, window: Window | None = None, *more: Column) -> DataFrame:
    """Rows of the tenant (None: of all) that meet every clause: one filter, analysed once."""
    check_tenant(tenant)
    parts = [all_of(spec.filters), in_window(window) if window else None, *in_months(df, spec, window), *more]
    if tenant is not None:
        parts.insert(0, F.col("tenant") == tenant)
    parts = [p for p in parts if p is not None]
    return df.where(reduce(and_, parts)) if parts else df


def in_months(df: DataFrame, spec: Spec, window: Window | None) -> list[Column]:
    """Predicates that prune the month partitions of a stored table to those that the time bounds allow."""
    if "month" not in df.columns:
        return []
    reduced = reduce_window(spec.filters)
    bounds = [w for w in (reduced and reduced[0], window) if w]
    first = max((w.lo for w in bounds if w.lo is not None), default=None)
    last = min((w.hi for w in bounds if w.hi is not None), default=None)
    out = [] if first is None else [F.col("month") >= f"{first:%Y-%m}"]
    return out if last is None else [*out, F.col("month") <= f"{last - TICK:%Y-%m}"]


def value_of(kind: str, aggregate: str | None) -> Column:
    """SUM of events, the latest gauge value (ties in time go to the larger id), or the maximum."""
    if aggregate == "max":
        return F.max("value")
    return F.sum("value") if kind == schema.EVENT else F.max_by("value", F.struct("time", "id"))


def _sorted(df: DataFrame, orders: list[tuple[str, bool]]) -> DataFrame:
    return df.orderBy(*[F.col(a).desc_nulls_last() if d else F.col(a).asc_nulls_last() for a, d in orders])


def _page(df: DataFrame, spec: Spec) -> DataFrame:
    df = df.offset(spec.offset) if spec.offset else df
    return df if spec.limit is None else df.limit(spec.limit)


def cursor_orders(spec: Spec) -> list[tuple[str, bool]]:
    """The order that a cursor stands in: as asked, then by id."""
    orders = list(spec.orders)
    return orders if "id" in [a for a, _ in orders] else [*orders, ("id", orders[-1][1] if orders else False)]


def find_rows(df: DataFrame, kind: str, tenant: str | None, spec: Spec) -> DataFrame:
    """Whole rows, nulls last in either direction; a cursor starts behind (before) its row."""
    check(spec, kind)
    orders, more = list(spec.orders), []
    if spec.cursor is not None:
        orders = cursor_orders(spec)
        more = [after_cursor(orders, spec.cursor, spec.before)]
    rows = filtered(df, tenant, spec, None, *more)
    have = set(df.columns)
    rows = rows.select(*[c for c in schema.table_schema(kind).fieldNames() if c in have])
    if spec.cursor is None:
        return _page(_sorted(rows, orders) if orders else rows, spec)
    if not spec.before:
        return _page(_sorted(rows, orders), spec)
    # backwards from the cursor, where nulls come first
    page = _page(rows.orderBy(*[F.col(a).asc_nulls_first() if d else F.col(a).desc_nulls_first() for a, d in orders]), spec)
    return _sorted(page, orders)


def group_keys(spec: Spec) -> list[str]:
    return ["metric", *(["bucket"] if spec.interval else []), *spec.dims]


def groups(df: DataFrame, kind: str, tenant: str | None, spec: Spec) -> DataFrame:
    """metric[, bucket][, dims], value: unordered."""
    rows = filtered(df, tenant, spec)
    if spec.interval:
        rows = rows.withColumn("bucket", bucket(F.col("time"), spec.interval))
    return rows.groupBy(*group_keys(spec)).agg(value_of(kind, spec.aggregate).alias("value"))


def finish_grouped(df: DataFrame, spec: Spec) -> DataFrame:
    """Order, page and name the columns: metric, value[, time][, dims]. Ties follow the group keys."""
    keys = group_keys(spec)
    if spec.orders:
        orders = [("bucket" if a == "time" else a, d) for a, d in spec.orders]
    else:
        orders = [("bucket", False)] if spec.interval else [("value", True)]
    orders += [(k, False) for k in keys if k not in [a for a, _ in orders]]
    paged = _page(_sorted(df, orders), spec)
    return paged.select("metric", "value", *([F.col("bucket").alias("time")] if spec.interval else []), *spec.dims)


def find_grouped(df: DataFrame, kind: str, tenant: str | None, spec: Spec) -> DataFrame:
    check(spec, kind)
    return finish_grouped(groups(df, kind, tenant, spec), spec)


def count_rows(df: DataFrame, kind: str, tenant: str | None, spec: Spec, most: int | None = None) -> DataFrame:
    """One row, n; with `most` no more than that many rows are looked for."""
    check(spec, kind)
    if most is not None and most < 0:
        raise ValueError("max must not be negative")
    rows = filtered(df, tenant, spec).select(F.lit(1).alias("one"))
    return (rows if most is None else rows.limit(most)).agg(F.count(F.lit(1)).alias("n"))


def total(df: DataFrame, kind: str, tenant: str | None, spec: Spec, aggregate: str = "default") -> DataFrame:
    """One row: total (0 when nothing matches) and found (whether anything does)."""
    rows = filtered(df, tenant, spec)
    value = F.sum("value") if aggregate == "sum" else value_of(kind, None)
    return rows.agg(F.coalesce(value, F.lit(0).cast("bigint")).alias("total"), (F.count(F.lit(1)) > 0).alias("found"))


def totals(df: DataFrame, kind: str, tenant: str | None, metrics: list[str], spec: Spec) -> DataFrame:
    """metric, total: a row for each asked metric that has rows."""
    rows = filtered(df, tenant, spec, None, F.col("metric").isin(*metrics) if metrics else F.lit(False))
    return rows.groupBy("metric").agg(value_of(kind, None).alias("total"))


def with_missing(found: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, total, found: a row for each asked metric, 0 where nothing matches."""
    # the asked names come from the caller, not from the data
    names = F.array(*[F.lit(m) for m in dict.fromkeys(metrics)]).cast("array<string>")
    asked = found.sparkSession.range(0, 1, 1, 1).select(F.explode(names).alias("metric"))
    joined = asked.join(found, "metric", "left")
    return joined.select("metric", F.coalesce("total", F.lit(0).cast("bigint")).alias("total"), F.col("total").isNotNull().alias("found"))
