"""The insert-triggered daily rollup as a stream.

Partial sums add up, so late rows need neither state nor a watermark: each micro-batch writes its own
sums. A batch's sums go to a folder of its own, by the stream's id and the batch's number, that a retry
overwrites, so that a batch that is run twice counts once and another stream's sums stay. `sink.stream_into` keeps
the rollup of a store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import rollups
from ..operators.rollups import fold_daily
from .sink import stream_id


def stream_daily(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start the rollup of a streaming DataFrame of events."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rollups.daily(batch).write.mode("overwrite").parquet(f"{path}/batch={stream_id(batch.sparkSession, checkpoint)}-{batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """The rollup so far, one row for each key."""
    return fold_daily(spark.read.option("basePath", path).parquet(path).drop("batch"))
