"""Time series on a calendar grid, filled with zeros (events) or the last value (gauges)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema
from ..functions.buckets import bucket
from ..functions.predicates import literal
from ..plans.query import Spec
from ..plans.window import TICK
from ..plans.window import Window as Span
from .reads import filtered, value_of

STEPS = {"1h": "INTERVAL 1 HOUR", "1d": "INTERVAL 1 DAY"}


def check_interval(interval: str) -> None:
    if interval not in STEPS:
        raise ValueError(f"Invalid interval '{interval}'. Allowed: {', '.join(STEPS)}")


def buckets(df: DataFrame, kind: str, tenant: str | None, metrics: list[str], interval: str, start: datetime, end: datetime, spec: Spec) -> DataFrame:
    """metric, bucket, value of the points with start <= time <= end."""
    check_interval(interval)
    rows = filtered(df, tenant, spec, Span(start, end + TICK), F.col("metric").isin(*metrics))
    return rows.groupBy("metric", bucket(F.col("time"), interval).alias("bucket")).agg(value_of(kind, None).alias("value"))


def grid(df: DataFrame, metrics: list[str], interval: str, start: datetime, end: datetime) -> DataFrame:
    """metric, bucket: labels of start, start + step, ... up to end, floored.

    The steps begin at the unfloored start, so the bucket of a partial last step has no label; totals
    count its points nevertheless.
    """
    asked = df.sparkSession.createDataFrame([(m,) for m in dict.fromkeys(metrics)], "metric string")
    if start > end:
        return asked.where(F.lit(False)).select("metric", F.lit(None).cast("timestamp_ntz").alias("bucket"))
    steps = F.sequence(literal("time", start), literal("time", end), F.expr(STEPS[interval]))
    labels = asked.select("metric", F.explode(steps).alias("t"))
    return labels.select("metric", bucket(F.col("t"), interval).alias("bucket"))


def zero_fill(points: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.join(points, ["metric", "bucket"], "left").select("metric", "bucket", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))


def carry_forward(points: DataFrame, labels: DataFrame) -> DataFrame:
    """The last value seen in the window so far; 0 before the first one.

    The labels of one metric are the caller's window cut in steps, so a metric is a small partition.
    """
    line = W.partitionBy("metric").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    joined = labels.join(points, ["metric", "bucket"], "left")
    return joined.select("metric", "bucket", F.coalesce(F.last("value", ignorenulls=True).over(line), F.lit(0).cast("bigint")).alias("value"))


def time_series(df: DataFrame, kind: str, tenant: str | None, metrics: list[str], interval: str, start: datetime, end: datetime, spec: Spec, fill: bool = True) -> DataFrame:
    points = buckets(df, kind, tenant, metrics, interval, start, end, spec)
    if not fill:
        return points
    labels = grid(df, metrics, interval, start, end)
    return zero_fill(points, labels) if kind == schema.EVENT else carry_forward(points, labels)
