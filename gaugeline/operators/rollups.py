"""Rollups of events and gauges. Rows are partial: readers fold them again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import bucket
from ..schema import DAILY_DIMS


def _day(c: str):
    return bucket(F.col(c), "1d")


def daily(events: DataFrame) -> DataFrame:
    """Sums by tenant, metric, day and the daily dimensions."""
    have = [d for d in DAILY_DIMS if d in events.columns]
    rows = events.select("tenant", "metric", _day("time").alias("day"), *have, "value")
    sums = rows.groupBy("tenant", "metric", "day", *have).agg(F.sum("value").alias("value"))
    return sums.select("metric", "value", F.col("day").alias("time"), "tenant", *have)


def hourly(events: DataFrame, dim: str) -> DataFrame:
    """Sums by tenant, metric, hour and one dimension."""
    rows = events.select("tenant", "metric", bucket(F.col("time"), "1h").alias("hour"), dim, "value")
    return rows.groupBy("tenant", "metric", "hour", dim).agg(F.sum("value").alias("value")).select("metric", "value", F.col("hour").alias("time"), "tenant", dim)


def latest(gauges: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The latest row of each tenant, metric and dimension set."""
    best = F.max(F.struct("time", "id", "value")).alias("best")
    return gauges.groupBy("tenant", "metric", *dims).agg(best).select("metric", F.col("best.value").alias("value"), F.col("best.time").alias("time"), F.col("best.id").alias("id"), "tenant", *dims)


def fold_daily(rows: DataFrame) -> DataFrame:
    """Partial daily rows, one for each key."""
    keys = [c for c in rows.columns if c != "value"]
    return rows.groupBy(*keys).agg(F.sum("value").alias("value")).select(*rows.columns)
