"""Parquet storage: raw tables and rollups by month, the ledger by buckets of its streams, sorted within files.

Every append writes its rollup rows in the same call, as partial sums that readers fold. Parquet has no row
deletes: a purge finds the files that hold rows it hits, writes their other rows to new files and drops them;
of rollups, only the keys of deleted rows are made anew.

A change of several tables is written to `_staged` first. Then a file in `_pending` that lists the files it adds
and drops commits it; the renames follow, and the file goes. Each rename can be repeated, by anybody, so `recover`
ends what an interrupted writer left: a change happens as a whole or, if it wasn't committed, not at all. A
commit is refused with `Conflict`, and nothing is changed, if what it wrote or what it is to drop is no longer
there. While a change is pending, readers take raw rows only. Writers should take turns: of two that rewrite the
same file, one is refused.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict
from datetime import UTC, datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.buckets import bucket
from ..functions.hashing import sample_bucket
from ..operators import rollups, samples

BASE = ("events", "gauges", "events_daily", "samples", "uncovered")
#: Tables without partitions.
FLAT = ("uncovered",)
#: Drafts of a change that this many seconds have passed since are taken for abandoned.
LEASE = 86_400
UNCOVERED = T.StructType([T.StructField("day", T.TimestampNTZType()), T.StructField("change", T.IntegerType())])


def hourly_name(dim: str) -> str:
    return f"events_hourly_{dim}"


def latest_name(dims) -> str:
    return "gauges_latest_" + "_".join(dims)


class Conflict(RuntimeError):
    """Another writer has changed what this one was about to change; nothing has been done."""


class Store:
    def __init__(self, spark: SparkSession, path: str, namespace: str = ""):
        self.spark = spark
        self.path = path.rstrip("/") + (f"/{namespace}" if namespace else "")
        self._counts: tuple[float, dict[str, dict[str, int]]] | None = None
        #: Frames of a version, kept by their maker.
        self.kept: tuple[str, object] | None = None

    # -- places

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self._at(name))
        return fs.exists(p)

    @staticmethod
    def _part(name: str) -> T.StructField:
        """What the table is partitioned by."""
        return T.StructField("bucket", T.IntegerType()) if name == "samples" else T.StructField("month", T.StringType())

    def months(self, name: str) -> list[str]:
        """The table's partitions that hold files."""
        return sorted({f.split("/")[0].split("=")[1] for f in self._files_in(name) if "=" in f})

    def _schema(self, name: str) -> T.StructType:
        fixed = {"events": schema.EVENTS, "gauges": schema.GAUGES, "events_daily": schema.EVENTS_DAILY, "samples": schema.SAMPLES, "uncovered": UNCOVERED}
        if name in fixed:
            return fixed[name]
        kind, n = (schema.EVENTS, name.removeprefix("events_hourly_")) if name.startswith("events_hourly_") else (schema.GAUGES, name.removeprefix("gauges_latest_"))
        extra = ["id"] if kind is schema.GAUGES else []
        return T.StructType([kind[c] for c in ("metric", "value", "time", *extra, "tenant", *n.split("_"))])

    def setup(self, retention_days: int | None = None) -> None:
        """Create the tables, and make the retention what is asked for (None: none).

        Harmless at any time: what other writers have under way is left alone.
        """
        if retention_days is not None and retention_days < 1:
            raise ValueError("retention must be at least a day")
        for name in BASE:
            fs, p = self._fs(self._at(name))
            fs.mkdirs(p)
        if retention_days != self.retention_days():
            self._put("_properties/retention.json", {"days": retention_days})

    def retention_days(self) -> int | None:
        return (self._get("_properties/retention.json") or {}).get("days")

    def names(self) -> list[str]:
        """All tables there are."""
        return [n for n in (*BASE, *map(hourly_name, schema.HOURLY_DIMS), *map(latest_name, schema.LATEST_DIMS)) if self.exists(n)]

    def version(self) -> str | None:
        """The last change of any table, by any writer: as long as it is the same, so are the tables' files."""
        return (self._get("_properties/version.json") or {}).get("change")

    def row_counts(self, max_age: float = 600) -> dict[str, dict[str, int]]:
        """Rows of each table by month, from the files' footers.

        For estimates only: counts up to max_age seconds old will do, so a busy writer doesn't make readers count anew.
        """
        now = time.monotonic()
        if self._counts is None or now - self._counts[0] > max_age:
            names = [n for n in self.names() if self._part(n).name == "month" and n not in FLAT and self._has_files(n)]
            self._counts = (now, {n: {m: r["n"] for m, r in self.by_month(n).items()} for n in names})
        return self._counts[1]

    def by_month(self, name: str, months: list[str] | None = None) -> dict[str, dict]:
        """n, the rows, and most, the largest value, of each month (of these months): from the files' footers, no row is read."""
        with self._pushed_down():
            return {r["month"]: {"n": r["n"], "most": r["most"]} for r in self._summed(name, months).collect()}  # a row a month

    def _summed(self, name: str, months: list[str] | None) -> DataFrame:
        rows = self.spark.read.schema(self._stored(name)).parquet(self._at(name))
        rows = rows if months is None else rows.where(F.col("month").isin(months))
        return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))

    @contextmanager
    def _pushed_down(self) -> Iterator[None]:
        """Frames made and run in here give counts, least and largest values to the Parquet reader, which has them in footers."""
        want = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
        had = {k: self.spark.conf.get(k) for k in want}
        for k, v in want.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in had.items():
                self.spark.conf.set(k, v)

    # -- changes

    def _put(self, name: str, content: dict) -> None:
        """A small file, in full or not at all."""
        fs, p = self._fs(self._at(name))
        _, draft = self._fs(self._at(f"{name}.{uuid.uuid4().hex}"))
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        fs.delete(p, False)
        fs.rename(draft, p)

    def _get(self, name: str) -> dict | None:
        fs, p = self._fs(self._at(name))
        if not fs.exists(p):
            return None
        try:
            file = fs.open(p)
        except Py4JJavaError:
            if fs.exists(p):
                raise
            return None  # it went, or is about to be replaced
        try:
            return json.loads(bytes(file.readAllBytes()))
        finally:
            file.close()

    def pending(self) -> list[str]:
        fs, p = self._fs(self._at("_pending"))
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def _stage(self, change: str, name: str, df: DataFrame, small: bool = False) -> None:
        self._write(df, name, at=f"{self.path}/_staged/{change}/{name}", small=small)

    def marked(self, name: str) -> dict | None:
        """What the last change with this mark said."""
        return self._get(name)

    def finish(self, mark: str) -> None:
        """End committed changes with this mark, which their writer left."""
        for f in self.pending():
            record = self._get(f"_pending/{f}")
            if record and mark in record["marks"]:
                self._apply(f.removesuffix(".json"), record)
                self._forget(f"_staged/{f.removesuffix('.json')}")

    @contextmanager
    def _draft(self) -> Iterator[str]:
        """The name of a change to stage and commit; if it isn't committed, what was staged goes."""
        change = uuid.uuid4().hex
        try:
            yield change
        finally:
            if not self.exists(f"_pending/{change}.json"):
                self._forget(f"_staged/{change}")
                self._forget("_staged", empty=True)

    def _commit(self, change: str, tables: list[str], drops: list[str] = (), marks: dict[str, dict] | None = None) -> None:
        """Put in place the files that `_staged/<change>` has of these tables, and take those of `drops` away.

        marks are small files (name -> content) that change with it.
        """
        gone = [f for f in (*(f"_staged/{change}/{n}/_SUCCESS" for n in tables), *drops) if not self.exists(f)]
        if gone:
            raise Conflict(f"another writer has removed {', '.join(gone[:3])}{' and more' if len(gone) > 3 else ''}")
        record = {"adds": [f"{n}/{f}" for n in tables for f in self._files_in(f"_staged/{change}/{n}")], "drops": list(drops), "marks": marks or {}}
        if record["adds"] or record["drops"]:
            self._put(f"_pending/{change}.json", record)
            self._apply(change, record)

    def _apply(self, change: str, record: dict) -> None:
        """End a committed change; whatever was done of it before, here or elsewhere, isn't done again."""
        for f in record["adds"]:
            if not self.exists(f) and not self.exists(f"_staged/{change}/{f}"):
                raise Conflict(f"{f} of the committed change {change} is lost")
        for f in record["drops"]:
            if self.exists(f):
                self._move(f, f"_staged/{change}/_aside/{f}")
        for f in record["adds"]:
            if not self.exists(f):
                self._move(f"_staged/{change}/{f}", f)
        for folder in {f.rsplit("/", 1)[0] for f in record["drops"]}:
            self._forget(folder, empty=True)
        for name, content in record["marks"].items():
            self._put(name, content)
        self._put("_properties/version.json", {"change": change})
        self._forget(f"_pending/{change}.json")

    def _forget(self, name: str, empty: bool = False) -> None:
        """Delete a file or folder; a folder only where it has nothing in it, if `empty`."""
        fs, p = self._fs(self._at(name))
        if not empty:
            fs.delete(p, True)
        elif fs.exists(p) and not len(fs.listStatus(p)):
            try:
                fs.delete(p, False)
            except Py4JJavaError:  # something has been put there since
                pass

    def _move(self, source: str, place: str) -> None:
        fs, a = self._fs(self._at(source))
        _, b = self._fs(self._at(place))
        fs.mkdirs(b.getParent())
        if not fs.rename(a, b) and not fs.exists(b):
            raise OSError(f"could not move {source} to {place}")

    def _files_in(self, name: str) -> list[str]:
        """Data files of a table, below it by partition or not."""
        fs, p = self._fs(self._at(name))
        out = []
        for s in fs.listStatus(p) if fs.exists(p) else []:
            n = s.getPath().getName()
            out += [f"{n}/{f}" for f in self._files_in(f"{name}/{n}")] if s.isDirectory() else [n] if n.endswith(".parquet") else []
        return out

    def _has_files(self, name: str) -> bool:
        fs, p = self._fs(self._at(name))
        files = fs.listFiles(p, True) if fs.exists(p) else None
        while files and files.hasNext():
            if files.next().getPath().getName().endswith(".parquet"):
                return True
        return False

    def recover(self, lease: float = LEASE) -> int:
        """End committed changes, and drop the drafts of those that nobody commits; how many there were to end.

        Drafts younger than `lease` seconds may be another writer's, and stay; should one be dropped all the same,
        its commit is refused.
        """
        left = self.pending()
        for f in left:
            if record := self._get(f"_pending/{f}"):
                self._apply(f.removesuffix(".json"), record)
                self._forget(f"_staged/{f.removesuffix('.json')}")
        fs, p = self._fs(self._at("_staged"))
        old = datetime.now(UTC).timestamp() * 1000 - lease * 1000
        for s in fs.listStatus(p) if fs.exists(p) else []:
            change = s.getPath().getName()
            if s.getModificationTime() <= old and f"{change}.json" not in self.pending():
                self._forget(f"_staged/{change}")
        self._forget("_staged", empty=True)
        return len(left)

    def compact(self, files: int = 8) -> int:
        """Rewrite the partitions of tables that more than so many files make up; how many there were."""
        n = 0
        for name in self.names():
            if name in FLAT:
                continue
            there = self._files_in(name)
            many = {part: k for part, k in Counter(f.split("/")[0] for f in there).items() if k > files}
            if many:
                n += len(many)
                drops = [f"{name}/{f}" for f in there if f.split("/")[0] in many]
                rows = self._of_files(name, drops).drop(self._part(name).name)
                folds = name == "events_daily" or name.startswith("events_hourly_")
                self._replace([(name, rollups.fold_daily(rows) if folds else rows, drops)])
        return n

    # -- reading

    def read(self, name: str) -> DataFrame:
        """The table, with the declared schema; the partition's column is for pruning."""
        if not self._has_files(name):
            return self.spark.createDataFrame([], self._schema(name))
        return self.spark.read.schema(self._stored(name)).parquet(self._at(name))

    def _stored(self, name: str) -> T.StructType:
        declared = self._schema(name)
        return declared if name in FLAT else T.StructType([*declared.fields, self._part(name)])

    def _of_files(self, name: str, files: list[str]) -> DataFrame:
        """Rows of some of the table's files (`name/partition/file`)."""
        if not files:
            return self.spark.createDataFrame([], self._stored(name))
        return self.spark.read.schema(self._stored(name)).option("basePath", self._at(name)).parquet(*map(self._at, files))

    def hourly_dims(self) -> list[str]:
        return [d for d in schema.HOURLY_DIMS if self.exists(hourly_name(d))]

    def latest_dims(self) -> list[tuple[str, ...]]:
        return [d for d in schema.LATEST_DIMS if self.exists(latest_name(d))]

    def uncovered_days(self) -> set[datetime]:
        """Days with raw events that the daily rollup lacks."""
        if not self._has_files("uncovered"):
            return set()
        return {r["day"] for r in self.read("uncovered").groupBy("day").agg(F.sum("change").alias("n")).where("n > 0").collect()}

    # -- writing

    def _write(self, df: DataFrame, name: str, mode: str = "append", at: str | None = None, small: bool = False) -> None:
        if name in FLAT:
            df.write.mode(mode).parquet(at or self._at(name))
            return
        part = self._part(name).name
        rows = df.drop(part)
        if name == "samples":
            rows, keys = rows.withColumn(part, sample_bucket()), [*schema.SAMPLE_STREAM, "sequence"]
        else:
            rows = rows.withColumn(part, F.date_format("time", "yyyy-MM"))
            keys = [c for c in ("tenant", "metric", "time", "id") if c in rows.columns]
        # ranges of (partition, keys) keep files sorted and their statistics narrow, and split a large
        # partition, tenant or stream over tasks; a batch from the driver is one file a partition
        rows = rows.coalesce(1) if small else rows.repartitionByRange(part, *(keys if name == "samples" else keys[:3]))
        rows = rows.sortWithinPartitions(part, *keys)
        w = rows.write.mode(mode).partitionBy(part).option("compression", "zstd")
        if name in ("events", "gauges"):
            for d in schema.BLOOM_DIMS:
                if d in rows.columns:
                    w = w.option(f"parquet.bloom.filter.enabled#{d}", "true")
        w.parquet(at or self._at(name))

    def append(self, df: DataFrame, kind: str, small: bool = False, covered: bool = True, marks: dict[str, dict] | None = None) -> None:
        """Raw rows and their rollup rows; `small` is for what the driver holds anyway.

        The rows are made once; rollups are made of what was written. If not `covered`, events get no daily
        rollup rows, and their days await a backfill.
        """
        base = "events" if kind == schema.EVENT else "gauges"
        with self._draft() as change:
            tables = [base]
            self._stage(change, base, df.select(*schema.table_schema(kind).fieldNames()), small)
            if self._has_files(f"_staged/{change}/{base}"):
                rows = self._staged(change, base)
                for name, rollup in self._rollups(kind):
                    if covered or name != "events_daily":
                        self._stage(change, name, rollup(rows), small)
                        tables.append(name)
                if not covered:
                    self._stage(change, "uncovered", rows.select(F.date_trunc("day", "time").cast("timestamp_ntz").alias("day"), F.lit(1).alias("change")).distinct())
                    tables.append("uncovered")
            self._commit(change, tables, marks=marks)

    def _staged(self, change: str, name: str) -> DataFrame:
        return self.spark.read.schema(self._stored(name)).parquet(f"{self.path}/_staged/{change}/{name}")

    def _rollups(self, kind: str):
        if kind == schema.EVENT:
            return [("events_daily", rollups.daily), *((hourly_name(d), lambda df, d=d: rollups.hourly(df, d)) for d in self.hourly_dims())]
        return [(latest_name(d), lambda df, d=d: rollups.latest(df, d)) for d in self.latest_dims()]

    def append_raw(self, df: DataFrame) -> None:
        """Events without daily rollup rows, as from before the rollup existed."""
        self.append(df, schema.EVENT, covered=False)

    def append_samples(self, df: DataFrame, small: bool = False) -> None:
        """Rows of the ledger, in the buckets of their streams, sorted by stream and sequence."""
        with self._draft() as change:
            self._stage(change, "samples", df.select(*schema.SAMPLES.fieldNames()), small)
            self._commit(change, ["samples"])

    # -- stored watermarks of the ledger

    def store_watermark(self, r: samples.SampleRange, limit: int) -> samples.StoredWatermark:
        """Write the range's first `limit` entries to a table of their own; the driver gets their count and digest.

        The properties file comes last, so a watermark is there in full or not at all.
        """
        samples.check_limit(limit)
        name = uuid.uuid4().hex
        samples.members(self.read("samples"), r).write.parquet(self._at(f"_watermarks/{name}"))
        entries = self.spark.read.parquet(self._at(f"_watermarks/{name}"))
        truncated = entries.count() > limit
        if truncated:
            samples.first_members(entries, limit).write.parquet(self._at(f"_watermarks/{name}-draft"))
            self._forget(f"_watermarks/{name}")
            self._move(f"_watermarks/{name}-draft", f"_watermarks/{name}")
        count, digest = samples.count_and_digest(self.spark.read.parquet(self._at(f"_watermarks/{name}")))
        fields = {k: v.isoformat(sep=" ") if isinstance(v, datetime) else v for k, v in asdict(r).items()}
        self._put(f"_watermarks/{name}.json", {"range": fields, "count": count, "digest": digest, "truncated": truncated})
        return samples.StoredWatermark(r, name, count, digest, truncated)

    def watermark(self, name: str) -> samples.StoredWatermark:
        """A watermark that was stored before, here or elsewhere."""
        kept = self._get(f"_watermarks/{name}.json")
        if kept is None:
            raise ValueError(f"There is no watermark {name}")
        r = {k: datetime.fromisoformat(v) if k.startswith("interval") else v for k, v in kept["range"].items()}
        return samples.StoredWatermark(samples.SampleRange(**r), name, kept["count"], kept["digest"], kept["truncated"])

    def drop_watermark(self, name: str) -> None:
        for n in (f"_watermarks/{name}.json", f"_watermarks/{name}"):
            self._forget(n)

    def members(self, mark: samples.StoredWatermark) -> DataFrame:
        """The watermark's entries, once their number and digest are what it says."""
        entries = self.spark.read.parquet(self._at(f"_watermarks/{mark.name}"))
        if samples.count_and_digest(entries) != (mark.count, mark.digest):
            raise ValueError(f"the table of watermark {mark.name} isn't the one that was stored")
        return entries

    def declare_hourly(self, dim: str) -> None:
        """Build an hourly rollup from the events there are; later appends keep it."""
        if dim not in schema.HOURLY_DIMS:
            raise ValueError(f"No hourly rollup by '{dim}'. Allowed: {', '.join(schema.HOURLY_DIMS)}")
        self._declare(hourly_name(dim), lambda: rollups.hourly(self.read("events"), dim))

    def declare_latest(self, dims) -> None:
        dims = tuple(dims)
        if dims not in schema.LATEST_DIMS:
            raise ValueError(f"No latest-value rollup by {dims}")
        self._declare(latest_name(dims), lambda: rollups.latest(self.read("gauges"), dims))

    def _declare(self, name: str, rows) -> None:
        if self.exists(name):
            return
        with self._draft() as change:
            self._stage(change, name, rows())
            self._commit(change, [name])
        fs, p = self._fs(self._at(name))
        fs.mkdirs(p)  # a rollup of nothing is declared too
        self._put("_properties/version.json", {"change": uuid.uuid4().hex})

    def _replace(self, tables: list[tuple[str, DataFrame, list[str]]], adds: list[tuple[str, DataFrame]] = ()) -> None:
        """One change: of each (table, rows, files), rows in the place of these files; of each of adds, more rows."""
        with self._draft() as change:
            for name, rows, *_ in (*tables, *adds):
                self._stage(change, name, rows)
            self._commit(change, [t[0] for t in (*tables, *adds)], [f for _, _, files in tables for f in files])

    def _files_of(self, name: str, rows: DataFrame) -> list[str]:
        """The files that these rows of the table are in: as many as the table has at most."""
        found = rows.select(F.col("_metadata.file_path").alias("f")).distinct().collect()
        return sorted(f"{name}/" + "/".join(r["f"].split("/")[-2:]) for r in found)

    def delete(self, kind: str, condition: Column | None) -> dict[str, int]:
        """Remove the rows that the condition holds for (None: all), and what rollups have of them.

        Only files that hold such rows are written anew, without them.  Of a rollup, the same holds for
        files with rows of the deleted rows' keys (of latest values: rows that are deleted rows); what the
        survivors give for these keys is added.  The result tells how many files of each table went.
        """
        base = "events" if kind == schema.EVENT else "gauges"
        rows = self.read(base)
        hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        files = self._files_of(base, rows.where(hit)) if "month" in rows.columns else []
        if not files:
            return {}
        gone = self._of_files(base, files).where(hit)
        tables = [(base, self._of_files(base, files).where(~hit), files)]
        months = sorted({f.split("/")[1].split("=")[1] for f in files})
        bare = self.uncovered_days() if kind == schema.EVENT else set()
        for name, rollup in self._rollups(kind):
            have = self.read(name)
            if "month" not in have.columns:
                continue
            if kind == schema.GAUGE:
                # a row of the rollup that was deleted: its key's latest value is to be found again, in any month
                row = ["tenant", "metric", "time", "id", *name.removeprefix("gauges_latest_").split("_")]
                key, hits, source = [c for c in row if c not in ("time", "id")], _meeting(have.where(F.col("month").isin(months)), gone, row), rows.where(~hit)
                keys = hits.select(key).distinct()
                off = row
            else:
                day = bucket(F.col("time"), "1d")
                covered = ~day.isin(sorted(bare)) if name == "events_daily" and bare else F.lit(True)
                keys = rollup(gone.where(covered)).drop("value")
                key = off = keys.columns
                hits = _meeting(have.where(F.col("month").isin(months)), keys, key)
                source = rows.where(F.col("month").isin(months) & ~hit & covered)
            touched = self._files_of(name, hits)
            if not touched:
                continue
            left = _meeting(self._of_files(name, touched), gone if kind == schema.GAUGE else keys, off, "left_anti")
            # only the survivors of these keys are folded
            at = None if kind == schema.GAUGE else day if name == "events_daily" else bucket(F.col("time"), "1h")
            fresh = rollup(_meeting(source, keys, key, time=at))
            tables.append((name, left.drop("month").unionByName(fresh), touched))
        self._replace(tables)
        return {n: len(f) for n, _, f in tables}

    def backfill_daily(self, start: datetime, end: datetime, force: bool = False) -> None:
        """Recompute the daily rollup of whole days, start <= day < end."""
        for t in (start, end):
            if t != t.replace(hour=0, minute=0, second=0, microsecond=0):
                raise ValueError("Backfill bounds must be UTC midnights")
        if start >= end:
            raise ValueError("Backfill start must be before its end")
        inside = (F.col("time") >= F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")) & (F.col("time") < F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz"))
        have = self.read("events_daily")
        if not force and have.where(inside).limit(1).count():
            raise ValueError("The daily rollup has rows in this range; use force to replace them")
        fresh = rollups.daily(self.read("events").where(inside))
        months = [f"{y:04d}-{m:02d}" for y, m in _months(start, end)]
        counts = {r["day"]: r["n"] for r in self.read("uncovered").groupBy("day").agg(F.sum("change").alias("n")).where("n > 0").collect()}
        covered = [(d, -int(n)) for d, n in sorted(counts.items()) if start <= d < end]
        adds = [("uncovered", self.spark.createDataFrame(covered, UNCOVERED))] if covered else []
        drops = [f"events_daily/{f}" for f in self._files_in("events_daily") if f.split("/")[0].split("=")[1] in months]
        keep = self._of_files("events_daily", drops).where(~inside).select(*schema.EVENTS_DAILY.fieldNames())
        self._replace([("events_daily", keep.unionByName(fresh.select(*schema.EVENTS_DAILY.fieldNames())), drops)], adds)

    def apply_retention(self, now: datetime, days: int | None = None) -> None:
        """Drop events older than the table's retention, or so many days: whole months by their folders, the boundary month by a rewrite."""
        days = self.retention_days() if days is None else days
        if days is None:
            return
        if days < 1:
            raise ValueError("retention must be at least a day")
        now = now.astimezone(UTC).replace(tzinfo=None) if now.tzinfo else now
        cutoff = now - timedelta(days=days)
        edge = f"{cutoff.year:04d}-{cutoff.month:02d}"
        names = ("events", "events_daily", *(hourly_name(d) for d in self.hourly_dims()))
        old = [f"{name}/{f}" for name in names for f in self._files_in(name) if f.split("/")[0].split("=")[1] < edge]
        if old:
            with self._draft() as change:
                self._commit(change, [], old)
        at = F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")
        self.delete(schema.EVENT, (F.col("month") == edge) & (F.col("time") < at))

    def migrate(self, name: str) -> int:
        """Rewrite the files whose columns have other types than declared; how many there were.

        Columns that a file lacks read as null, and those that aren't declared aren't read, so neither needs a rewrite.
        """
        files = self._differing(name, [f"{name}/{f}" for f in self._files_in(name)])
        if files:
            self._replace([(name, self._of_files(name, files), files)])
        return len(files)

    def _differing(self, name: str, files: list[str]) -> list[str]:
        """Files with another type of a declared column: footers are read by Spark, halves of the files at a time."""
        if not files:
            return []
        declared = {f.name: f.dataType for f in self._schema(name)}
        try:
            merged = self.spark.read.option("mergeSchema", "true").option("basePath", self._at(name)).parquet(*map(self._at, files)).schema
            if all(declared.get(f.name, f.dataType) == f.dataType for f in merged):
                return []
        except AnalysisException:  # the footers don't agree
            pass
        except Exception as e:
            if "MERGE_SCHEMA" not in str(e):
                raise
        half = len(files) // 2
        return files if len(files) == 1 else [*self._differing(name, files[:half]), *self._differing(name, files[half:])]


def _meeting(rows: DataFrame, others: DataFrame, by: list[str], how: str = "left_semi", time: Column | None = None) -> DataFrame:
    """Rows that some of the others equal (left_semi) or none does (left_anti) in these columns, nulls like values.

    If `time` is given, it stands for the rows' column of that name.
    """
    named = others.select(*[F.col(c).alias(f"{c}_other") for c in by]).distinct()
    mine = {c: time if c == "time" and time is not None else F.col(c) for c in by}
    return rows.join(named, [mine[c].eqNullSafe(F.col(f"{c}_other")) for c in by], how)


def _months(start: datetime, end: datetime):
    y, m = start.year, start.month
    while datetime(y, m, 1) < end:
        yield y, m
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
