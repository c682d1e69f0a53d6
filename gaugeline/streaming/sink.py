"""A stream of rows into the store: raw rows and all their rollups at once, each micro-batch once.

A batch is one change of the store, whose record also says up to which batch the stream has come.  A batch that Spark
runs again is first ended, if its writer died after its commit, and then skipped, as it is already there.  Streams
are told apart by the id that their checkpoint keeps, so a new checkpoint is a new stream and never takes an
old one's place.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that the checkpoint belongs to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    file = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(bytes(file.readAllBytes()))["id"]
    finally:
        file.close()


def stream_into(store: Store, rows: DataFrame, kind: str, checkpoint: str, made: Callable[[DataFrame], DataFrame] = lambda batch: batch, trigger: dict | None = None) -> StreamingQuery:
    """Start appending a streaming DataFrame; `made` turns a batch of it into rows of the table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        mark = f"_streams/{stream_id(store.spark, checkpoint)}.json"
        store.finish(mark)
        if batch_id > (store.marked(mark) or {"batch": -1})["batch"]:
            store.append(made(batch), kind, marks={mark: {"batch": batch_id}})

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
