"""The facade: everything a metering service asks for, for one tenant at a time or across all."""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterable, Mapping
from dataclasses import replace
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import schema
from .functions.predicates import all_of, check_tenant
from .operators import ingest, paging, reads, samples, series
from .operators.rollups import fold_daily
from .plans import query as q
from .plans import router
from .plans.window import reduce_window, whole_months
from .sources.store import Store
from .sources.tables import Frames, of_store
from .streaming.sink import stream_into


class Meter:
    """Reads from a store or from Frames; writes need a store.

    `now` is a clock (UTC, naive) that tests may fix. `sample_rate` is the share of routed sums that are
    compared with the raw scan. With `by_cost` a rollup is read only where that takes fewer rows than the raw scan, by
    the store's counts (or the Frames' `rows`); without it, wherever one answers.
    """

    def __init__(self, source: Store | Frames, shared: bool = True, now=None, sample_rate: float = 0.0, by_cost: bool = False):
        self._source, self.shared, self.sample_rate, self.by_cost = source, shared, sample_rate, by_cost
        self._now = now or (lambda: datetime.now(UTC).replace(tzinfo=None))
        self._log: deque[dict[str, Any]] = deque(maxlen=1000)
        self._next_id: str | None = None
        self._stats = {"queries": 0, "rows": 0}

    # -- tables

    @property
    def store(self) -> Store:
        if not isinstance(self._source, Store):
            raise TypeError("This needs a store")
        return self._source

    def tables(self) -> Frames:
        return of_store(self._source, self.by_cost) if isinstance(self._source, Store) else self._source

    def setup(self, retention_days: int | None = None) -> None:
        """Create the tables and make the events' retention what is asked for; None strips it."""
        self.store.setup(retention_days)

    def migrate(self) -> None:
        for name in self.store.names():
            self.store.migrate(name)

    def health_check(self) -> dict[str, Any]:
        spark = self.store.spark
        tables = {n: self.store.exists(n) for n in ("events", "gauges", "events_daily", "samples")}
        return {"healthy": spark.sql("select 1").first()[0] == 1 and all(tables.values()), "version": spark.version, "tables": tables}

    def get_route_log(self) -> list[dict[str, Any]]:
        return list(self._log)

    def clear_route_log(self) -> None:
        self._log.clear()

    def set_next_query_id(self, name: str) -> None:
        """Describe the next action's jobs by this name."""
        self._next_id = name

    def get_stats(self) -> dict[str, int]:
        """Queries run and rows fetched so far."""
        return dict(self._stats)

    def _collect(self, df: DataFrame) -> list:
        sc = df.sparkSession.sparkContext
        name, self._next_id = self._next_id, None
        sc.setJobDescription(name)
        try:
            rows = df.collect()
        finally:
            sc.setJobDescription(None)
        self._stats["queries"] += 1
        self._stats["rows"] += len(rows)
        return rows

    def _tenant(self, tenant: str | None) -> str | None:
        check_tenant(tenant)
        if tenant is None and self.shared:
            raise ValueError("A tenant is required")
        return tenant if self.shared else None

    # -- writes

    def add_batch(self, metrics: list[Mapping[str, Any]], kind: str, batch_size: int = 1000) -> bool:
        """Append rows; all are checked first."""
        ingest.validate_batch(metrics, kind, self.shared)
        if metrics:  # one append holds any number of rows, so the batch size has nothing to cut
            self.store.append(ingest.to_frame(self.store.spark, metrics, kind, self._now()), kind, small=True)
        return True

    def add_frame(self, df: DataFrame, kind: str, allow_negative: bool = False) -> bool:
        """Append a DataFrame of any size; all of it is checked first."""
        self.store.append(ingest.from_frame(df, kind, self.shared, allow_negative, self._now()), kind)
        return True

    def add_valid(self, df: DataFrame, kind: str, allow_negative: bool = False) -> DataFrame:
        """Append the rows that break no rule; the others come back with the rule in the column `refused`, for the caller to write or show."""
        judged = df.withColumn("refused", ingest.refusals(df, kind, self.shared, allow_negative))
        self.add_frame(judged.where("refused is null").drop("refused"), kind, allow_negative)
        return judged.where("refused is not null")

    def add_stream(self, rows: DataFrame, kind: str, checkpoint: str, allow_negative: bool = False, trigger: dict | None = None) -> StreamingQuery:
        """Append a streaming DataFrame, batch by batch, each of them checked and written once; rollups follow at once."""
        return stream_into(self.store, rows, kind, checkpoint, lambda batch: ingest.from_frame(batch, kind, self.shared, allow_negative, self._now()), trigger)

    def accumulator(self) -> ingest.Accumulator:
        return ingest.Accumulator(self)

    def add_samples(self, rows: Iterable[samples.Sample]) -> bool:
        rows = list(rows)
        if rows:
            self.store.append_samples(samples.to_frame(self.store.spark, rows), small=True)
        return True

    def purge(self, tenant: str, queries: Iterable[q.Query] = (), kind: str | None = None) -> bool:
        """Delete the tenant's rows that match every filter; order, paging and grouping don't matter."""
        tenant = self._tenant(tenant)
        spec = q.Spec(filters=q.parse(queries).filters)
        for k in [kind] if kind else schema.TYPES:
            if kind is None and not q.applies(spec, k):
                continue
            q.check(spec, k)
            condition = all_of(spec.filters)
            if tenant is not None:
                mine = F.col("tenant") == tenant
                condition = mine if condition is None else mine & condition
            self.store.delete(k, condition)
        return True

    def backfill_daily(self, start, end, force: bool = False) -> None:
        self.store.backfill_daily(q.utc(start), q.utc(end), force)

    def apply_retention(self, days: int | None = None) -> None:
        """Drop events that are older than so many days (None: than the retention that setup was given)."""
        self.store.apply_retention(self._now(), days)

    # -- reads

    def find_df(self, tenant: str | None, queries: Iterable[q.Query] = (), kind: str | None = None) -> DataFrame:
        """Rows or, with grouping or an aggregate, groups, with a column `type`."""
        return self._find(self._tenant(tenant), q.parse(queries), kind)

    def find_across_tenants_df(self, queries: Iterable[q.Query], kind: str | None = None) -> DataFrame:
        """The same without a tenant; groups merge tenants unless grouped by tenant."""
        if not self.shared:
            raise ValueError("Reads across tenants need shared tables")
        return self._find(None, q.parse(queries), kind)

    def find(self, tenant: str | None, queries: Iterable[q.Query] = (), kind: str | None = None) -> list[dict[str, Any]]:
        return [r.asDict() for r in self._collect(self.find_df(tenant, queries, kind))]

    def find_across_tenants(self, queries: Iterable[q.Query], kind: str | None = None) -> list[dict[str, Any]]:
        return [r.asDict() for r in self._collect(self.find_across_tenants_df(queries, kind))]

    def _find(self, tenant: str | None, spec: q.Spec, kind: str | None) -> DataFrame:
        if kind is not None:
            return self._find_one(tenant, spec, kind).withColumn("type", F.lit(kind))
        if spec.cursor is not None:
            raise ValueError("A cursor needs an explicit type")
        kinds = [k for k in schema.TYPES if q.applies(spec, k)]
        if not kinds:
            q.check(spec, schema.EVENT)
        # events first, then gauges, each in its order, cut to the limit over both
        inner = replace(spec, offset=None, limit=None if spec.limit is None else spec.limit + (spec.offset or 0))
        parts = [self._find_one(tenant, inner, k).withColumn("type", F.lit(k)) for k in kinds]
        if len(parts) == 1:
            return self._find_one(tenant, spec, kinds[0]).withColumn("type", F.lit(kinds[0]))
        if not spec.orders and spec.limit is None and not spec.offset and not spec.grouped:
            return parts[0].unionByName(parts[1], allowMissingColumns=True)  # nothing asks for an order
        ranked = [p.withColumn("rank_", F.struct(F.lit(i).alias("k"), F.monotonically_increasing_id().alias("n"))) for i, p in enumerate(parts)]
        both = ranked[0].unionByName(ranked[1], allowMissingColumns=True).orderBy("rank_")
        both = both.offset(spec.offset) if spec.offset else both
        return (both if spec.limit is None else both.limit(spec.limit)).drop("rank_")

    def _find_one(self, tenant: str | None, spec: q.Spec, kind: str) -> DataFrame:
        t = self.tables()
        if not spec.grouped:
            raw = paging.paged(t.raw(kind), kind, tenant, spec, t.months.get(f"{kind}s", []))
            return reads.find_rows(raw, kind, tenant, spec)
        q.check(spec, kind)
        slate = router.latest_route(spec, kind, list(t.latest))
        if slate:
            self._note("find", "latest", kind)
            return reads.find_grouped(t.latest[slate], kind, tenant, spec)
        route = router.hourly_route(spec, kind, list(t.hourly))
        rows = None
        if self.by_cost and kind == schema.EVENT:
            route, rows = router.cheapest(route, spec, t.rows, f"events_hourly_{route.dim}")
        self._note("find", route.label, kind, rows)
        return router.routed_groups(route, kind, tenant, spec, t.raw(kind), t.hourly)

    def count(self, tenant: str | None, queries: Iterable[q.Query] = (), kind: str | None = None, most: int | None = None) -> int:
        """Matching rows, no more than `most`; order and paging don't matter."""
        tenant, spec = self._tenant(tenant), self._filters(queries)
        kinds = [kind] if kind else [k for k in schema.TYPES if q.applies(spec, k)]
        if not kinds:
            q.check(spec, schema.EVENT)
        n = sum(self._count(tenant, spec, k, most) for k in kinds)
        return n if most is None else min(n, most)

    def _count(self, tenant: str | None, spec: q.Spec, kind: str, most: int | None) -> int:
        """Of all tenants in a window: whole months from the files' footers, the others' rows counted; else all counted."""
        t, reduced = self.tables(), reduce_window(spec.filters)
        months = t.months.get(f"{kind}s")
        if tenant is not None or not months or reduced is None or reduced[1]:
            return self._collect(reads.count_rows(t.raw(kind), kind, tenant, spec, most))[0]["n"]
        if most is not None and most < 0:
            raise ValueError("max must not be negative")
        inside, edges = whole_months(reduced[0], months)
        n = sum(r["n"] for r in self.store.by_month(f"{kind}s", inside).values()) if inside else 0
        for e in edges:
            if most is None or n < most:
                rows = reads.filtered(t.raw(kind), None, q.Spec(), e).select(F.lit(1).alias("one"))
                rows = rows if most is None else rows.limit(most - n)
                n += self._collect(rows.agg(F.count(F.lit(1)).alias("n")))[0]["n"]
        return n

    def _filters(self, queries: Iterable[q.Query]) -> q.Spec:
        spec = q.parse(queries)
        if spec.grouped:
            raise ValueError("Grouping and aggregates have no meaning here")
        return q.Spec(filters=spec.filters)

    def sum(self, tenant: str | None, queries: Iterable[q.Query] = (), attribute: str = "value", kind: str = schema.EVENT) -> int:
        if attribute != "value":
            raise ValueError(f"Cannot sum '{attribute}'")
        tenant, spec = self._tenant(tenant), self._filters(queries)
        q.check(spec, kind)
        t = self.tables()
        if kind == schema.GAUGE:
            return self._collect(reads.total(t.gauges, kind, tenant, spec, "sum"))[0]["total"]
        return self._routed_sum(tenant, spec, t)

    def sum_df(self, tenant: str | None, queries: Iterable[q.Query] = ()) -> DataFrame:
        tenant, spec, t = self._tenant(tenant), self._filters(queries), self.tables()
        q.check(spec, schema.EVENT)
        route = self._sum_route(spec, t)
        return router.routed_sum(route, tenant, spec, t.events, t.events_daily)

    def _sum_route(self, spec: q.Spec, t: Frames) -> router.Route:
        route, rows = router.Route("raw") if t.events_daily is None else router.sum_route(spec, self._now(), t.uncovered), None
        if self.by_cost:
            route, rows = router.cheapest(route, spec, t.rows, "events_daily")
        self._note("sum", route.label, schema.EVENT, rows)
        return route

    def _routed_sum(self, tenant: str | None, spec: q.Spec, t: Frames) -> int:
        route = self._sum_route(spec, t)
        got = self._collect(router.routed_sum(route, tenant, spec, t.events, t.events_daily))[0]["total"]
        if route.cover is not None and random.random() < self.sample_rate:
            raw = reads.total(t.events, schema.EVENT, tenant, spec, "sum").first()["total"]
            self._log.append({"operation": "sample", "routed": got, "raw": raw, "off": abs(got - raw) > 0.01 * max(abs(raw), 1)})
        return got

    def _note(self, operation: str, label: str, kind: str, rows: float | None = None) -> None:
        self._log.append({"operation": operation, "route": label, "type": kind, "at": self._now()} | ({} if rows is None else {"rows": round(rows)}))

    def get_total(self, tenant: str | None, metric: str, queries: Iterable[q.Query] = (), kind: str | None = None) -> int:
        return self.get_total_batch(tenant, [metric], queries, kind)[metric]

    def get_total_batch(self, tenant: str | None, metrics: list[str], queries: Iterable[q.Query] = (), kind: str | None = None) -> dict[str, int]:
        """Event sums or latest gauge values by metric, 0 where there is none.

        Without a type a metric may be of either; one with rows in both is an error.
        """
        if not metrics:
            return {}
        tenant, spec = self._tenant(tenant), self._filters(queries)
        kinds = [kind] if kind else [k for k in schema.TYPES if q.applies(spec, k)]
        if not kinds:
            q.check(spec, schema.EVENT)
        out, found = dict.fromkeys(metrics, 0), set()
        for k in kinds:
            for r in self._collect(self._totals(tenant, metrics, spec, k)):
                if r["metric"] in found:
                    raise ValueError(f"Metric '{r['metric']}' exists as event and as gauge; state the type")
                found.add(r["metric"])
                out[r["metric"]] = r["total"]
        return out

    def totals_df(self, tenant: str | None, metrics: list[str], spec: q.Spec, kind: str) -> DataFrame:
        """metric, total, found: a row for each asked metric."""
        return reads.with_missing(self._totals(tenant, metrics, spec, kind), metrics)

    def _totals(self, tenant: str | None, metrics: list[str], spec: q.Spec, kind: str) -> DataFrame:
        q.check(spec, kind)
        t = self.tables()
        if kind == schema.GAUGE:
            return reads.totals(t.gauges, kind, tenant, metrics, spec)
        return router.routed_totals(self._sum_route(spec, t), tenant, metrics, spec, t.events, t.events_daily)

    def get_time_series(self, tenant: str | None, metrics: list[str], interval: str, start, end, queries: Iterable[q.Query] = (), zero_fill: bool = True, kind: str | None = None) -> dict[str, dict[str, Any]]:
        """metric -> total and data, a list of (value, date). Totals add the points' values, of gauges too."""
        series.check_interval(interval)
        tenant, spec, a, b = self._tenant(tenant), self._filters(queries), q.utc(start), q.utc(end)
        out = {m: {"total": 0, "data": []} for m in metrics}
        if not metrics:
            return out
        kinds = [kind] if kind else [k for k in schema.TYPES if q.applies(spec, k)]
        points: dict[str, tuple[str, list]] = {}
        for k in kinds:
            q.check(spec, k)
            rows = self._collect(series.buckets(self.tables().raw(k), k, tenant, metrics, interval, a, b, spec))
            for r in sorted(rows, key=lambda r: (r["metric"], r["bucket"])):  # a row a bucket: sorted here, a range sort would sample first
                points.setdefault(r["metric"], (k, []))[1].append((r["bucket"], r["value"]))
        fill_as = kind or schema.EVENT
        labels = _labels(interval, a, b)
        for m in metrics:
            k, seen = points.get(m, (fill_as, []))
            out[m]["total"] = sum(v for _, v in seen)
            if not zero_fill:
                out[m]["data"] = [{"value": v, "date": t} for t, v in seen]
                continue
            at, last = dict(seen), 0
            for t in labels:
                last = at.get(t, last if k == schema.GAUGE else 0)
                out[m]["data"].append({"value": last, "date": t})
        return out

    def time_series_df(self, tenant: str | None, metrics: list[str], interval: str, start, end, queries: Iterable[q.Query] = (), fill: bool = True, kind: str = schema.EVENT) -> DataFrame:
        """metric, bucket, value."""
        spec = self._filters(queries)
        q.check(spec, kind)
        return series.time_series(self.tables().raw(kind), kind, self._tenant(tenant), metrics, interval, q.utc(start), q.utc(end), spec, fill)

    # -- the daily rollup

    def _daily(self) -> DataFrame:
        d = self.tables().events_daily
        if d is None:
            raise ValueError("There is no daily rollup")
        return d.drop("month")

    def _daily_spec(self, queries: Iterable[q.Query]) -> q.Spec:
        spec = q.parse(queries)
        allowed = {"metric", "value", "time", "tenant", *schema.DAILY_DIMS}
        for name in {x.attribute for x in spec.filters} | {a for a, _ in spec.orders}:
            if name not in allowed:
                raise ValueError(f"Invalid daily attribute: {name}")
        if spec.grouped or spec.cursor is not None:
            raise ValueError("Daily reads take filters, order and paging")
        return spec

    def find_daily_df(self, tenant: str | None, queries: Iterable[q.Query] = ()) -> DataFrame:
        """Daily rows; times are compared with the start of the day."""
        spec, rows = self._daily_spec(queries), self._daily()
        # filters on keys come before the fold, one on the folded value after it
        keys = replace(spec, filters=tuple(f for f in spec.filters if f.attribute != "value"))
        folded = fold_daily(reads.filtered(rows, self._tenant(tenant), keys))
        after = all_of(f for f in spec.filters if f.attribute == "value")
        folded = folded if after is None else folded.where(after)
        orders = [*spec.orders, *((a, False) for a in ("time", "metric", "tenant") if a not in dict(spec.orders))]
        return reads._page(reads._sorted(folded, orders), spec)

    def find_daily(self, tenant: str | None, queries: Iterable[q.Query] = ()) -> list[dict[str, Any]]:
        return [r.asDict() for r in self._collect(self.find_daily_df(tenant, queries))]

    def sum_daily_df(self, tenant: str | None, queries: Iterable[q.Query] = ()) -> DataFrame:
        return reads.filtered(self._daily(), self._tenant(tenant), self._daily_spec(queries)).agg(F.coalesce(F.sum("value"), F.lit(0).cast("bigint")).alias("total"))

    def sum_daily(self, tenant: str | None, queries: Iterable[q.Query] = ()) -> int:
        return self._collect(self.sum_daily_df(tenant, queries))[0]["total"]

    def sum_daily_batch_df(self, tenant: str | None, metrics: list[str], queries: Iterable[q.Query] = ()) -> DataFrame:
        rows = reads.filtered(self._daily(), self._tenant(tenant), self._daily_spec(queries)).where(F.col("metric").isin(*metrics))
        return reads.with_missing(rows.groupBy("metric").agg(F.sum("value").alias("total")), metrics).drop("found")

    def sum_daily_batch(self, tenant: str | None, metrics: list[str], queries: Iterable[q.Query] = ()) -> dict[str, int]:
        return {r["metric"]: r["total"] for r in self._collect(self.sum_daily_batch_df(tenant, metrics, queries))} if metrics else {}

    # -- samples

    def get_sample_watermark(self, r: samples.SampleRange, limit: int) -> samples.SampleWatermark:
        return samples.watermark(self.tables().samples, r, limit)

    def find_samples(self, r: samples.SampleRange, mark: samples.SampleWatermark, limit: int) -> samples.SampleResult:
        return samples.find(self.tables().samples, r, mark, limit)

    def store_sample_watermark(self, r: samples.SampleRange, limit: int) -> samples.StoredWatermark:
        """A watermark of any size: its entries are a table of the store."""
        return self.store.store_watermark(r, limit)

    def find_sample_frames(self, r: samples.SampleRange, mark: samples.StoredWatermark) -> samples.SampleFrames:
        """What the snapshot has of the range, as frames; nothing of it comes to the driver."""
        if not mark.matches(r):
            raise ValueError("this watermark was taken of another range")
        entries = self.store.members(mark)
        return samples.frames(samples.seen(self.tables().samples, r, entries, mark.count), r)

    def for_tenant(self, tenant: str) -> Tenant:
        return Tenant(self, tenant)


def _labels(interval: str, start: datetime, end: datetime) -> list[datetime]:
    from .plans.window import DAY, HOUR, floor

    step, t, out = {"1h": HOUR, "1d": DAY}[interval], start, []
    while t <= end:
        out.append(floor(t, step))
        t += step
    return out


class Tenant:
    """A Meter bound to one tenant."""

    FORWARDED = ("find", "find_df", "count", "sum", "sum_df", "get_total", "get_total_batch", "get_time_series", "time_series_df", "purge", "find_daily", "find_daily_df", "sum_daily", "sum_daily_batch")

    def __init__(self, meter: Meter, tenant: str):
        if not isinstance(tenant, str) or tenant == "":
            raise ValueError("Tenant must be a non-empty string")
        self._meter, self.tenant = meter, tenant

    def __getattr__(self, name: str):
        if name not in self.FORWARDED:
            raise AttributeError(name)
        method = getattr(self._meter, name)
        return lambda *a, **k: method(self.tenant, *a, **k)

    def add_batch(self, metrics: list[Mapping[str, Any]], kind: str, batch_size: int = 1000) -> bool:
        """Rows are stamped with the tenant, whatever they say."""
        return self._meter.add_batch([{**m, "tenant": self.tenant} for m in metrics], kind, batch_size)
