"""Time buckets. All times are UTC; results keep the type timestamp_ntz."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.query import INTERVALS


def bucket(time: Column, interval: str) -> Column:
    """Start of the bucket of `time`; weeks start on Mondays."""
    unit = INTERVALS[interval]
    if " " in unit:
        return F.window(time, unit)["start"].cast("timestamp_ntz")
    return F.date_trunc(unit, time).cast("timestamp_ntz")
