"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the word definitions of the operators know: 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names.

    Where none is named, a temporary one will do if the driver and the executors are one process; else it
    is an error, as executors don't see each other's folders.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gaugeline-checkpoint-"))


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What a frame made in here has shuffled goes from the executors' disks as soon as it has been written.

    Else it stays until the driver happens to collect its garbage.  The session's own value comes back after it.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files.

    Cuts the lineage, so that later stages neither recompute the input nor lose it with an executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


#: Folders that this process wrote beside the checkpoints and still needs.
_written: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared checkpoint folder, for clear_tables to delete."""
    ensure_checkpoint_dir(spark)
    _written.append(f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def clear_tables(spark: SparkSession) -> None:
    """Delete what went to shared_folder, once the results that read from it are written elsewhere."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle_table(df: DataFrame) -> DataFrame:
    """Like settle, as a Parquet table beside the checkpoints: for wide rows of which later stages need some columns."""
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    with _shuffles_released(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def dealt_anew(col: str) -> F.Column:
    """The column as an expression that the planner doesn't take for the one an aggregate is dealt by.

    A join on it gets a shuffle of its own on either side, as Spark needs to split a hot key: it
    leaves a side that comes straight from an aggregate whole, and so the other one too.
    """
    return F.when(F.col(col).isNotNull(), F.col(col))


def numbered_columns(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on, so that no name of theirs can clash with an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores after it as far as the columns (of any case) have it already."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hex64(col) -> F.Column:
    """A signed 64-bit hash as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def worker_cache(key: str, make):
    """make() once for each Python worker and key: functions shipped by value lose module globals between tasks."""
    import sys
    import types

    held = sys.modules.setdefault("_gaugeline_worker_cache", types.ModuleType("_gaugeline_worker_cache")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


#: The most bytes that Spark puts in a batch for a Python worker.
BATCH_BYTES = 8 << 20


def _bound_batches(spark: SparkSession | None) -> None:
    """Lower the session's bound on the bytes of a batch to BATCH_BYTES, always the same; a lower one stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and int(spark.conf.get(key).removesuffix("b") if spark.conf.get(key).removesuffix("b").isdigit() else BATCH_BYTES + 1) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tidy(run, rows: int = 256):
    """A function of Arrow batches, given at most so many rows at a time, that tidies up when a task ends.

    A batch has BATCH_BYTES and a row at most, as the worker and the JVM both hold it; the slices bound what the
    function makes of it.  Workers wait for the next task with what their allocators hold, and several of
    them share an executor, so freed memory goes back to the system.
    """
    _bound_batches(SparkSession.getActiveSession())

    def tidied(batches):
        yield from run(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
        give_back()

    return tidied


def give_back() -> None:
    """Return what this process's allocators hold unused to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
