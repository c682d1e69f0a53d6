"""Bulk sources of events for load tests: any number of rows over 30 days, or a table's rows many times; made by the executors."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import literal

SECONDS = 30 * 86400
#: Dimension, prefix and number of values; strides differ, so that dimensions are not correlated.
SHAPE = (("path", "/v1/p", 1000, 1), ("method", "m", 6, 7), ("status", "s", 6, 11), ("service", "svc", 6, 13), ("country", "c", 10, 17), ("region", "r", 4, 19), ("hostname", "h", 10, 23), ("resourceType", "t", 4, 29), ("resourceId", "res", 5000, 31))


def events(spark: SparkSession, rows: int, start: datetime, tenant: str = "1", metric: str = "requests") -> DataFrame:
    i = F.col("i")
    dims = [F.concat(F.lit(prefix), ((i * stride) % n).cast("string")).alias(name) for name, prefix, n, stride in SHAPE]
    at = (literal("time", start).cast("timestamp").cast("long") + (i * 104729) % SECONDS).cast("timestamp").cast("timestamp_ntz")
    return spark.range(rows).select(F.col("id").alias("i")).select(i.cast("string").alias("id"), F.lit(metric).alias("metric"), (i % 1000 + 1).alias("value"), at.alias("time"), F.lit(tenant).alias("tenant"), *dims)


def multiplied(events: DataFrame, times: int, step_seconds: int) -> DataFrame:
    """Every event so many times: copy k has the id's `id-k`, comes k steps later and is worth k more."""
    rows = events.withColumn("k_", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return rows.withColumns({
        "id": F.concat("id", F.lit("-"), F.col("k_").cast("string")),
        "time": F.timestamp_add("SECOND", F.col("k_") * step_seconds, "time"),
        "value": F.col("value") + F.col("k_"),
    }).drop("k_")
