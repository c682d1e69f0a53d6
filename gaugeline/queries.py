"""The registered queries over a plain `events` table, with the SQL that checks them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Meter
from .operators import reads, rollups, samples
from .plans import query as q
from .sources import canonical, synthetic
from .sources.canonical import EV_SQL, SM_SQL
from .sources.tables import Frames
from .streaming.rollup import read_daily, stream_daily
from .written import empty as filled_none
from .written import filled, registered, scratch

LO, HI = "2024-01-03 10:37:21.456", "2024-01-20 04:14:03.789"
WINDOW = [q.greater_than_equal("time", LO), q.less_than_equal("time", HI)]
W = f"time >= timestamp '{LO}' AND time <= timestamp '{HI}'"
NOW = datetime(2024, 1, 25, 12)
METRICS = ["click", "view", "purchase", "signup", "error", "absent"]
_LIST = "(" + ", ".join(f"('{m}')" for m in METRICS) + ")"

_queries: dict = {}
_sql: dict[str, str] = {}


def _add(name: str, sql: str | None, f) -> None:
    _queries[name] = f
    if sql is not None:
        _sql[name] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {EV_SQL} {sql}"


def meter(spark: SparkSession, sf_dir: str, rolled: bool = False, now: datetime = NOW) -> Meter:
    t = canonical.frames(spark, sf_dir)
    if rolled:
        t.events_daily = rollups.daily(t.events)
        t.hourly = {d: rollups.hourly(t.events, d) for d in ("service", "country", "path")}
        t.latest = {("service",): rollups.latest(t.gauges, ("service",))}
    return Meter(t, now=lambda: now)


COLUMNS = ["id", "metric", "value", "time", "tenant", "path", "method", "status", "service", "country", "resourceType", "resourceId", "ordinal"]
ALL = ", ".join(COLUMNS)


def _find(name: str, where: str, clauses: list, tail: str = "") -> None:
    """Rows of events across tenants."""
    _add(f"find_{name}", f"SELECT {ALL}, 'event' AS type FROM ev WHERE {where} {tail}", lambda s, d: meter(s, d).find_across_tenants_df(clauses, "event"))


_find("raw_equal", "metric IN ('click', 'view') AND service = 'svc-2'", [q.equal("metric", ["click", "view"]), q.equal("service", ["svc-2"])])
_find("not_equal", f"service <> 'svc-2' AND country <> 'an' AND {W}", [q.not_equal("service", "svc-2"), q.not_equal("country", "an"), *WINDOW])
_find("less_greater", "value < 5000 AND value >= 1000 AND path > '/purchase/p5' AND status <= '301'", [q.less_than("value", 5000), q.greater_than_equal("value", 1000), q.greater_than("path", "/purchase/p5"), q.less_than_equal("status", "301")])
_find("between", f"time BETWEEN timestamp '{LO}' AND timestamp '{HI}' AND value BETWEEN 1000 AND 20000", [q.between("time", LO, HI), q.between("value", 1000, 20000)])
_find("not_between", "NOT (value BETWEEN 1000 AND 20000)", [q.not_between("value", 1000, 20000)])
_find("contains_any", "strpos(path, 'p1') > 0 OR strpos(path, '9') > 0", [q.contains_any("path", ["p1", "9"])])
_find("contains_literal", "strpos(path, '%') > 0 OR strpos(path, '_1') > 0 OR strpos(path, 'w/p4') > 0", [q.contains("path", ["%", "_1", "w/p4"])])
_find("not_contains", "strpos(path, '3') = 0 AND strpos(path, '/p2') = 0", [q.not_contains("path", ["3", "/p2"])])
_find("starts_with", "starts_with(path, '/view/p8')", [q.starts_with("path", "/view/p8")])
_find("ends_with", "ends_with(path, '7')", [q.ends_with("path", "7")])
_find("is_null", "country IS NULL", [q.is_null("country")])
_find("is_not_null", f"country IS NOT NULL AND {W}", [q.is_not_null("country"), *WINDOW])
_find("order_limit_offset", "true", [q.order_asc("country"), q.order_desc("value"), q.order_asc("id"), q.limit(200), q.offset(10)], "ORDER BY country NULLS LAST, value DESC NULLS LAST, id LIMIT 200 OFFSET 10")
_find("order_desc_nulls_last", "true", [q.order_desc("country"), q.order_asc("id"), q.limit(50)], "ORDER BY country DESC NULLS LAST, id LIMIT 50")
_CURSOR = {"time": "2024-01-10 00:00:00", "id": "500", "value": 100}
_find("cursor_after", "time > timestamp '2024-01-10' OR (time = timestamp '2024-01-10' AND id > '500')", [q.order_asc("time"), q.cursor_after(_CURSOR), q.limit(100)], "ORDER BY time, id LIMIT 100")
_find("cursor_before", "time < timestamp '2024-01-10' OR (time = timestamp '2024-01-10' AND id < '500')", [q.order_asc("time"), q.cursor_before(_CURSOR), q.limit(100)], "ORDER BY time DESC, id DESC LIMIT 100")
_add("find_tenant", f"SELECT {ALL}, 'event' AS type FROM ev WHERE tenant = '3' AND {W}", lambda s, d: meter(s, d).find_df("3", WINDOW, "event"))
_add("find_both_types", "SELECT * FROM (SELECT id, metric, value, time, tenant, service, resourceType, resourceId, ordinal, path, method, status, country, 'event' AS type FROM ev WHERE tenant = '3' AND service = 'svc-4' UNION ALL SELECT id, metric, value, time, tenant, service, resourceType, resourceId, ordinal, NULL, NULL, NULL, NULL, 'gauge' FROM ev WHERE tenant = '3' AND service = 'svc-4')", lambda s, d: meter(s, d).find_df("3", [q.equal("service", "svc-4")]))

_add("count_all", f"SELECT count(*) AS n FROM ev WHERE {W}", lambda s, d: _count(s, d, WINDOW, None))
_add("count_capped", f"SELECT least(count(*), 5000) AS n FROM ev WHERE {W}", lambda s, d: _count(s, d, WINDOW, 5000))
_add("sum_value", "SELECT CAST(coalesce(sum(value), 0) AS BIGINT) AS total FROM ev WHERE tenant = '3' AND metric = 'click'", lambda s, d: meter(s, d).sum_df("3", [q.equal("metric", "click")]))
_add("sum_nothing", "SELECT CAST(coalesce(sum(value), 0) AS BIGINT) AS total FROM ev WHERE metric = 'absent'", lambda s, d: meter(s, d).sum_df("3", [q.equal("metric", "absent")]))


def _count(spark, sf_dir, clauses, most):
    return reads.count_rows(canonical.events(spark, sf_dir), "event", None, q.parse(clauses), most)


def _batch(where: str, value: str = "sum(value)") -> str:
    return f"SELECT m.metric, CAST(coalesce(any_value(t), 0) AS BIGINT) AS total, any_value(t) IS NOT NULL AS found FROM (VALUES {_LIST[1:-1]}) m(metric) LEFT JOIN (SELECT metric, {value} AS t FROM ev WHERE {where} GROUP BY metric) USING (metric) GROUP BY m.metric"


_add("total_batch_with_missing", _batch(f"tenant = '4' AND {W}"), lambda s, d: meter(s, d).totals_df("4", METRICS, q.parse(WINDOW), "event"))
_add("gauge_total_batch", _batch(f"tenant = '4' AND {W}", "arg_max(value, (time, id))"), lambda s, d: meter(s, d).totals_df("4", METRICS, q.parse(WINDOW), "gauge"))


def _groups(name: str, select: str, keys: str, clauses: list, where: str = "true", value: str = "CAST(sum(value) AS BIGINT)", kind: str = "event", rolled: bool = False, tail: str = "") -> None:
    _add(name, f"SELECT metric, {value} AS value, {select}{', ' if select else ''}'{kind}' AS type FROM ev WHERE {where} GROUP BY metric{keys} {tail}", lambda s, d: meter(s, d, rolled).find_across_tenants_df(clauses, kind))


LATEST = "arg_max(value, (time, id))"
_groups("gauge_latest", "", "", [q.aggregate("max")], value="max(value)", kind="gauge")
_groups("gauge_latest_grouped", "service", ", service", [q.group_by("service"), *WINDOW], W, LATEST, "gauge")
_groups("gauge_latest_rollup", "service", ", service", [q.group_by("service")], "true", LATEST, "gauge", rolled=True)
_groups("gauge_max_1h", "date_trunc('hour', time) AS time", ", date_trunc('hour', time)", [q.aggregate("max"), q.group_by_interval("1h")], "true", "max(value)", "gauge")
_groups("event_max", "", "", [q.aggregate("max"), *WINDOW], W, "max(value)")
_groups("gauge_latest_1d", "date_trunc('day', time) AS time, ordinal", ", date_trunc('day', time), ordinal", [q.group_by_interval("1d"), q.group_by("ordinal")], "true", LATEST, "gauge")
for _dim in ("path", "country", "service", "status"):
    _groups(f"topn_{_dim}", _dim, f", {_dim}", [q.group_by(_dim), *WINDOW, q.limit(20)], W, tail=f"ORDER BY value DESC NULLS LAST, metric, {_dim} NULLS LAST LIMIT 20")
_groups("topn_path_country", "path, country", ", path, country", [q.group_by("path"), q.group_by("country"), q.equal("metric", ["click"]), *WINDOW, q.limit(50)], f"metric = 'click' AND {W}", tail="ORDER BY value DESC NULLS LAST, metric, path NULLS LAST, country NULLS LAST LIMIT 50")
_groups("topn_path_filtered_resource", "path", ", path", [q.group_by("path"), q.equal("resourceId", "r7"), *WINDOW], f"resourceId = 'r7' AND {W}")
_groups("grouped_order_time_desc", "date_trunc('day', time) AS time", ", date_trunc('day', time)", [q.group_by_interval("1d"), q.order_desc("time"), q.limit(30)], tail="ORDER BY date_trunc('day', time) DESC, metric LIMIT 30")
for _token, _name in (("1m", "1min"), ("5m", "5min"), ("15m", "15min"), ("30m", "30min"), ("1h", "1h"), ("1d", "1d"), ("1w", "1w"), ("1M", "1mon")):
    _unit = q.INTERVALS[_token]
    _start = f"time_bucket(INTERVAL '{_unit}', time)" if " " in _unit else f"date_trunc('{_unit}', time)"
    _groups(f"bucket_{_name}", f"CAST({_start} AS TIMESTAMP) AS time", f", {_start}", [q.group_by_interval(_token)])
_groups("bucket_1d_by_service", "date_trunc('day', time) AS time, service", ", date_trunc('day', time), service", [q.group_by_interval("1d"), q.group_by("service")])
_groups("bucket_1h_by_country", "date_trunc('hour', time) AS time, country", ", date_trunc('hour', time), country", [q.group_by_interval("1h"), q.group_by("country"), *WINDOW], W)
_groups("cross_tenant_totals", "tenant", ", tenant", [q.group_by("tenant")])
_groups("hourly_split_topn", "service", ", service", [q.group_by("service"), *WINDOW], W, rolled=True)
_groups("hourly_aligned_1d_by_country", "date_trunc('day', time) AS time, country", ", date_trunc('day', time), country", [q.group_by_interval("1d"), q.group_by("country"), q.greater_than_equal("time", "2024-01-04"), q.less_than("time", "2024-01-09 05:00:00")], "time >= timestamp '2024-01-04' AND time < timestamp '2024-01-09 05:00:00'", rolled=True)

_RANGE = ("2024-01-05 00:37:00", "2024-01-09 02:14:00")


def _series_sql(step: str, unit: str, value: str, fill: str) -> str:
    a, b = _RANGE
    return f"""WITH {EV_SQL}, pts AS (SELECT metric, date_trunc('{unit}', time) AS bucket, {value} AS v FROM ev WHERE tenant = '3' AND time BETWEEN timestamp '{a}' AND timestamp '{b}' GROUP BY 1, 2),
grid AS (SELECT metric, date_trunc('{unit}', unnest(generate_series(timestamp '{a}', timestamp '{b}', INTERVAL 1 {step}))) AS bucket FROM (VALUES ('click'), ('absent')) m(metric))
SELECT metric, CAST(bucket AS TIMESTAMP) AS bucket, CAST({fill} AS BIGINT) AS value FROM grid LEFT JOIN pts USING (metric, bucket)"""


for _i, _step, _u in (("1h", "HOUR", "hour"), ("1d", "DAY", "day")):
    _add(f"series_zero_fill_{_i}", _series_sql(_step, _u, "sum(value)", "coalesce(v, 0)"), lambda s, d, i=_i: meter(s, d).time_series_df("3", ["click", "absent"], i, *_RANGE))
    _add(f"series_locf_{_i}", _series_sql(_step, _u, LATEST, "coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY metric ORDER BY bucket ROWS UNBOUNDED PRECEDING), 0)"), lambda s, d, i=_i: meter(s, d).time_series_df("3", ["click", "absent"], i, *_RANGE, kind="gauge"))
_add("series_unfilled_1d", f"SELECT metric, date_trunc('day', time) AS bucket, CAST(sum(value) AS BIGINT) AS value FROM ev WHERE tenant = '3' AND metric IN ('click', 'view') AND time BETWEEN timestamp '{_RANGE[0]}' AND timestamp '{_RANGE[1]}' GROUP BY 1, 2", lambda s, d: meter(s, d).time_series_df("3", ["click", "view"], "1d", *_RANGE, fill=False))

_DAYS = [q.greater_than_equal("time", "2024-01-04"), q.less_than("time", "2024-01-12")]
_D = "time >= timestamp '2024-01-04' AND time < timestamp '2024-01-12'"
_add("daily_find", f"SELECT metric, CAST(sum(value) AS BIGINT) AS value, CAST(date_trunc('day', time) AS TIMESTAMP) AS time, tenant, resourceType, resourceId FROM ev WHERE tenant = '3' AND {_D} GROUP BY ALL", lambda s, d: meter(s, d, True).find_daily_df("3", _DAYS))
_add("daily_sum", f"SELECT CAST(coalesce(sum(value), 0) AS BIGINT) AS total FROM ev WHERE tenant = '3' AND resourceType = 'kind1' AND {_D}", lambda s, d: meter(s, d, True).sum_daily_df("3", [q.equal("resourceType", "kind1"), *_DAYS]))
_add("daily_sum_batch", _batch(f"tenant = '3' AND {_D}").replace(", any_value(t) IS NOT NULL AS found", ""), lambda s, d: meter(s, d, True).sum_daily_batch_df("3", METRICS, _DAYS))


def _routed(name: str, clauses: list, where: str, now: datetime = NOW) -> None:
    _add(f"routed_{name}", f"SELECT CAST(coalesce(sum(value), 0) AS BIGINT) AS total FROM ev WHERE tenant = '3' AND metric = 'click' AND {where}", lambda s, d: meter(s, d, True, now).sum_df("3", [q.equal("metric", "click"), *clauses]))


_routed("sum_daily", _DAYS, _D)
_routed("sum_hybrid", [q.greater_than_equal("time", "2024-01-04"), q.less_than("time", "2024-01-22 10:00:00")], "time >= timestamp '2024-01-04' AND time < timestamp '2024-01-22 10:00:00'", datetime(2024, 1, 20, 12))
_routed("sum_split", WINDOW, W)
_routed("sum_inclusive_midnight", [q.greater_than("time", "2024-01-04"), q.less_than_equal("time", "2024-01-12")], "time > timestamp '2024-01-04' AND time <= timestamp '2024-01-12'")
_add("routed_batch_split", _batch(f"tenant = '4' AND {W}"), lambda s, d: meter(s, d, True).totals_df("4", METRICS, q.parse(WINDOW), "event"))

_CANON = f"""WITH {SM_SQL}, r AS (SELECT min(sequence) AS first, max(sequence) AS last, min(intervalStart) AS a, max(intervalEnd) - INTERVAL 40 MINUTE AS z FROM sm),
g AS (SELECT member, sequence, arg_min(intervalStart, (value, intervalStart)) AS intervalStart, arg_min(intervalEnd, (value, intervalStart)) AS intervalEnd, count(DISTINCT ingestId) AS copies, count(DISTINCT (value, intervalStart, intervalEnd)) AS variants FROM sm GROUP BY member, sequence),
c AS (SELECT g.*, variants <> 1 OR intervalStart < a OR intervalEnd > z AS conflict, greatest(0, copies - greatest(1, variants)) AS duplicates FROM g, r),
ok AS (SELECT *, lag(sequence) OVER l AS before, lag(intervalEnd) OVER l AS ended, lead(sequence) OVER l AS following FROM c WHERE NOT conflict WINDOW l AS (PARTITION BY member ORDER BY sequence))"""


def _ledger(spark, sf_dir):
    """The classified ledger, and the range (first, last, start, end) that it is read for, from its own ends."""
    rows = canonical.samples(spark, sf_dir)
    r = rows.agg(F.min("sequence"), F.max("sequence"), F.min("intervalStart"), F.max("intervalEnd")).first()
    bounds = (r[0], r[1], r[2], r[3] - timedelta(minutes=40))
    return samples.classify(samples.canonical(rows), *bounds[2:]), bounds


def _good(spark, sf_dir, find):
    found, bounds = _ledger(spark, sf_dir)
    return find(found.where("not conflict"), *bounds)


_add("samples_canonical", f"{_CANON} SELECT member, sequence, intervalStart, intervalEnd, copies, variants, duplicates, conflict FROM c", lambda s, d: _ledger(s, d)[0].select("member", "sequence", "copies", "variants", "duplicates", "conflict", "intervalStart", "intervalEnd"))
_add("samples_conflicts", f"{_CANON} SELECT member, sequence FROM c WHERE conflict", lambda s, d: _ledger(s, d)[0].where("conflict").select("member", "sequence"))
_add("samples_gaps", f"{_CANON} SELECT coalesce(before, first - 1) + 1 AS gap_first, sequence - 1 AS gap_last FROM ok, r WHERE coalesce(before, first - 1) + 1 <= sequence - 1 UNION ALL SELECT sequence + 1, last FROM ok, r WHERE following IS NULL AND sequence < last", lambda s, d: _good(s, d, lambda rows, first, last, start, end: samples.gaps(rows, first, last)))
_add("samples_discontinuities", f"{_CANON} SELECT sequence FROM ok, r WHERE intervalStart <> coalesce(ended, a) OR (following IS NULL AND intervalEnd <> z)", lambda s, d: _good(s, d, lambda rows, first, last, start, end: samples.discontinuities(rows, start, end)))


def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top paths of twenty times the events, each copy eleven hours later."""
    rows = synthetic.multiplied(canonical.events(spark, sf_dir), 20, 39600)
    return Meter(Frames(rows, rows)).find_across_tenants_df([q.group_by("path"), q.greater_than_equal("time", "2024-01-05 10:20:30"), q.less_than("time", "2024-01-27"), q.limit(25)], "event")


_add("bulk_synthetic_topn", "SELECT metric, CAST(sum(value + k) AS BIGINT) AS value, path, 'event' AS type FROM ev, range(20) r(k) WHERE time + to_seconds(k * 39600) >= timestamp '2024-01-05 10:20:30' AND time + to_seconds(k * 39600) < timestamp '2024-01-27' GROUP BY metric, path ORDER BY value DESC, metric, path LIMIT 25", _bulk)


def _stored(spark: SparkSession, sf_dir: str) -> Meter:
    """A store filled with the canonical events."""
    return filled(spark, sf_dir, NOW)


def purge_then_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes one service's clicks of tenant 3, then sums by way of the rollup."""
    u = _stored(spark, sf_dir)
    u.purge("3", [q.equal("metric", "click"), q.equal("service", "svc-4"), *WINDOW], "event")
    return u.sum_df("3", [q.greater_than_equal("time", "2024-01-02"), q.less_than("time", "2024-01-22")])


def backfill_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputes some days of the daily rollup and reads it."""
    u = _stored(spark, sf_dir)
    u.backfill_daily("2024-01-04", "2024-01-12", force=True)
    return u.find_daily_df("3", _DAYS).select("metric", "value", "time", "tenant", "resourceType", "resourceId")


def stream_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams the events into the daily rollup and reads it."""
    at = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    files = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    stream_daily(files.selectExpr(*canonical._columns(canonical.EV)), f"{at}/daily", f"{at}/checkpoint").awaitTermination()
    return read_daily(spark, f"{at}/daily").select("metric", "value", "time", "tenant", "resourceType", "resourceId")


def stream_into_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams the events into a store with an hourly rollup, then reads services by way of it."""
    at, m = scratch(spark), filled_none(spark, NOW)
    m.store.declare_hourly("service")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    files = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = files.selectExpr(*canonical._columns(canonical.EV)).drop("id")
    for _ in range(2):  # the second start finds nothing new
        m.add_stream(rows, "event", f"{at}/checkpoint").awaitTermination()
    return m.find_across_tenants_df([q.group_by("service"), *WINDOW], "event")


_DAILY_ALL = "SELECT metric, CAST(sum(value) AS BIGINT) AS value, CAST(date_trunc('day', time) AS TIMESTAMP) AS time, tenant, resourceType, resourceId FROM ev {where} GROUP BY ALL"
_add("purge_then_sum", f"SELECT CAST(sum(value) AS BIGINT) AS total FROM ev WHERE tenant = '3' AND time >= timestamp '2024-01-02' AND time < timestamp '2024-01-22' AND NOT (metric = 'click' AND service = 'svc-4' AND {W})", purge_then_sum)
_add("backfill_parity", _DAILY_ALL.format(where=f"WHERE tenant = '3' AND {_D}"), backfill_parity)
_add("stream_into_store", f"SELECT metric, CAST(sum(value) AS BIGINT) AS value, service, 'event' AS type FROM ev WHERE {W} GROUP BY metric, service", stream_into_store)
_add("stream_daily_rollup", _DAILY_ALL.format(where=""), stream_daily_rollup)


_made, _checked = registered(EV_SQL, SM_SQL, LO, HI, WINDOW, NOW)
_queries |= _made
_sql |= _checked


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top services by metric over a window, from whole hours of a rollup and raw edges."""
    return _queries["hourly_split_topn"](spark, sf_dir)


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
