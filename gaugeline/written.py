"""Registered queries that write, and those that show what is refused, with the SQL that checks them.

Each works on a store of its own in a scratch folder, filled from the `events` table.  Calls that a client makes
from the driver (batches, the accumulator) take the rows of the table's last hour, as a client would send them.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Meter
from .functions.render import api_row
from .operators import ingest, reads, samples
from .plans import query as q
from .sources import canonical, ndjson
from .sources.store import Store
from .sources.tables import Frames, of_collection

_local: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A folder of our own: in the cluster's shared checkpoint folder; where none is named and all is one process, a temporary one.

    A temporary one is deleted when the process ends; others are the owner's of the shared folder to clean.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        atexit.register(lambda: [shutil.rmtree(x, ignore_errors=True) for x in _local])
    _local.append(tempfile.mkdtemp(prefix="gaugeline-"))
    return _local[-1]


def filled(spark: SparkSession, sf_dir: str, now: datetime, gauges: bool = False, before=lambda store: None) -> Meter:
    """A store with the canonical events, and the gauges if wanted; `before` sees it empty."""
    m = Meter(Store(spark, scratch(spark)), now=lambda: now)
    m.setup()
    before(m.store)
    t = canonical.frames(spark, sf_dir)
    for kind, df in (("event", t.events), *([("gauge", t.gauges)] if gauges else [])):
        missing = [c for c in m.store._schema(f"{kind}s").fieldNames() if c not in df.columns]
        m.store.append(df.withColumns({c: F.lit(None).cast("string") for c in missing}), kind)
    return m


def empty(spark: SparkSession, now: datetime = datetime(2026, 6, 20, 12), **k) -> Meter:
    m = Meter(Store(spark, scratch(spark)), now=lambda: now, **k)
    m.setup()
    return m


def registered(ev_sql: str, sm_sql: str, low: str, high: str, window: list, now: datetime) -> tuple[dict, dict[str, str]]:
    """(queries, SQL) by name, over the views `ev` and `sm`."""
    made: dict = {}
    sql: dict[str, str] = {}
    inside = f"time >= timestamp '{low}' AND time <= timestamp '{high}'"

    def add(text: str | None):
        def put(f):
            made[f.__name__] = f
            if text is not None:
                sql[f.__name__] = f"WITH {ev_sql}, {sm_sql} {text}"
            return f

        return put

    def values(rows: str, names: str) -> str:
        return f"SELECT * FROM (VALUES {rows}) t({names})"

    by_metric = "SELECT metric, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM ev {where} GROUP BY metric"

    def summed(m: Meter) -> DataFrame:
        return m.store.read("events").groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

    last_hour_sql = "time >= date_trunc('hour', (SELECT max(time) FROM ev))"

    def last_hour(spark, sf_dir) -> list[dict]:
        ev = canonical.events(spark, sf_dir)
        start = ev.agg(F.date_trunc("hour", F.max("time")).cast("timestamp_ntz").alias("t"))
        return [r.asDict() for r in ev.join(F.broadcast(start), F.col("time") >= F.col("t")).orderBy("time", "id").collect()]

    @add(f"SELECT tenant, metric, value, time, country, path, status, NULLIF(service, 'svc-3') AS service, ordinal FROM ev WHERE {last_hour_sql}")
    def ingest_batch(spark, sf_dir):
        """Times as text, every other one with an offset; tags in upper case, as numbers, and empty."""
        m, batch = empty(spark), []
        for r in last_hour(spark, sf_dir):
            odd = int(r["id"]) % 2
            time = (r["time"] + timedelta(hours=2)).isoformat() + "+02:00" if odd else r["time"].isoformat(sep=" ")
            tags = {"country": r["country"] and r["country"].upper(), "path": r["path"], "status": int(r["status"]), "service": "" if r["service"] == "svc-3" else r["service"], "ordinal": float(r["ordinal"])}
            batch.append({"tenant": r["tenant"], "metric": r["metric"], "value": r["value"], "time": time, "tags": tags})
        m.add_batch(batch, "event", 2)
        return m.find_across_tenants_df([], "event").select("tenant", "metric", "value", "time", "country", "path", "status", "service", "ordinal")

    flaws = "CASE CAST(id AS BIGINT) % 20 WHEN 0 THEN 'metric is missing or empty' WHEN 1 THEN 'metric is missing or empty' WHEN 2 THEN 'metric exceeds 255 bytes' WHEN 3 THEN 'value is missing' WHEN 4 THEN 'value is negative' WHEN 5 THEN 'tenant is missing or empty' WHEN 6 THEN 'time is none' WHEN 7 THEN 'country exceeds 2 bytes' WHEN 8 THEN 'method exceeds 16 bytes' END"

    @add(f"SELECT refused, count(*) AS n, CAST(sum(CAST(resourceId[2:] AS BIGINT)) AS BIGINT) AS r FROM (SELECT *, {flaws} AS refused FROM ev) GROUP BY refused")
    def ingest_refusals(spark, sf_dir):
        """Of events with all sorts of flaws, the sound ones are written and the others come back, each with its reason."""
        flaw, m = F.col("id").cast("bigint") % 20, empty(spark)

        def flawed(name: str, **by):
            out = F.col(name)
            for k, v in by.items():
                out = F.when(flaw == int(k[1:]), v).otherwise(out)
            return out.alias(name)

        rows = canonical.events(spark, sf_dir).select(
            flawed("metric", _0=F.lit(""), _1=F.lit(None), _2=F.repeat(F.lit("m"), 256)),
            flawed("value", _3=F.lit(None), _4=-F.col("value") - 1),
            flawed("tenant", _5=F.lit("")),
            F.when(flaw == 6, F.lit("soon")).otherwise(F.col("time").cast("string")).alias("time"),
            flawed("country", _7=F.lit("deu")),
            flawed("method", _8=F.repeat(F.lit("v"), 17)),
            "resourceId",
        )
        refused = m.add_valid(rows, "event").select("refused", "resourceId")
        kept = m.store.read("events").select(F.lit(None).cast("string").alias("refused"), "resourceId")
        return refused.union(kept).groupBy("refused").agg(F.count(F.lit(1)).alias("n"), F.sum(F.substring("resourceId", 2, 9).cast("bigint")).alias("r"))

    @add(by_metric.format(where=""))
    def ingest_frame(spark, sf_dir):
        m = empty(spark)
        m.add_frame(canonical.events(spark, sf_dir).drop("id"), "event")
        return summed(m)

    @add(by_metric.format(where=""))
    def ndjson_round_trip(spark, sf_dir):
        at = scratch(spark)
        ndjson.write(canonical.events(spark, sf_dir).drop("id"), f"{at}/lines", "event")
        m = empty(spark)
        m.add_frame(ndjson.read(spark, f"{at}/lines", "event"), "event")
        return summed(m)

    @add("SELECT tenant, metric, service, CAST(sum(value) AS BIGINT) AS value, min(time) AS time, min(id) AS id FROM ev GROUP BY tenant, metric, service")
    def accumulator_fold(spark, sf_dir):
        return ingest.fold(canonical.events(spark, sf_dir).select("tenant", "metric", "service", "value", "time", "id"))

    both_types = "SELECT tenant, metric, service, CAST(sum(value) AS BIGINT) AS value, min(time) AS time, {more} 'event' AS type FROM ev {where} GROUP BY tenant, metric, service UNION ALL SELECT tenant, metric, service, arg_max(value, (time, id)), max(time), {last} 'gauge' FROM ev {where} GROUP BY tenant, metric, service"

    @add(both_types.format(where="", more="bool_or(CAST(id AS BIGINT) % 7 = 0) AS allow_negative, min(id) AS id,", last="arg_max(CAST(id AS BIGINT) % 7 = 0, (time, id)), min(id),"))
    def accumulator_fold_types(spark, sf_dir):
        """Events add up and gauges keep the last call, in one aggregation; the order of arrival is that of (time, id)."""
        rows = canonical.events(spark, sf_dir).select("tenant", "metric", "service", "value", "time", "id", (F.col("id").cast("bigint") % 7 == 0).alias("allow_negative"), F.struct("time", "id").alias("arrived"))
        rows = rows.withColumn("type", F.explode(F.array(F.lit("event"), F.lit("gauge"))))
        return ingest.fold(rows, "arrived")

    @add(both_types.format(where=f"WHERE {last_hour_sql}", more="", last=""))
    def accumulator_flush(spark, sf_dir):
        """The last hour's events one by one, as events and as gauges."""
        m = empty(spark)
        a, keys = m.accumulator(), set()
        for r in last_hour(spark, sf_dir):
            for kind in ("event", "gauge"):
                a.collect(r["tenant"], r["metric"], r["value"], kind, {"service": r["service"]}, r["time"])
                keys.add((r["tenant"], r["metric"], r["service"], kind))
        assert a.count() == len(keys) and a.elapsed_seconds() >= 0 and a.flush() and a.count() == 0
        return m.find_across_tenants_df([]).select("tenant", "metric", "service", "value", "time", "type")

    @add(by_metric.format(where="WHERE time >= timestamp '2024-01-15 12:00:00'"))
    def retention(spark, sf_dir):
        m = filled(spark, sf_dir, now)
        m.setup(retention_days=10)  # now is noon of January 25
        m.apply_retention()
        return summed(m)

    @add(by_metric.format(where=""))
    def retention_stripped(spark, sf_dir):
        m = filled(spark, sf_dir, now)
        m.setup(retention_days=10)
        m.setup()
        m.apply_retention()
        return summed(m)

    @add("SELECT CAST(sum(value) AS BIGINT) AS total, count(*) AS n FROM ev")
    def migrate(spark, sf_dir):
        m = filled(spark, sf_dir, now, before=lambda s: s.declare_hourly("service"))
        m.migrate()
        daily = m.store.read("events_daily").agg(F.sum("value").alias("total"))
        hourly = m.store.read("events_hourly_service").agg(F.sum("value").alias("h"))
        n = m.store.read("events").agg(F.count(F.lit(1)).alias("n"))
        return daily.join(hourly, F.col("total") == F.col("h")).select("total").crossJoin(n)  # a row each

    @add(f"SELECT metric, CAST(sum(value) AS BIGINT) AS value, service, 'event' AS type FROM ev WHERE {inside} GROUP BY metric, service")
    def hourly_stored(spark, sf_dir):
        """By way of a rollup that was declared before the events came."""
        m = filled(spark, sf_dir, now, before=lambda s: s.declare_hourly("service"))
        out = m.find_across_tenants_df([q.group_by("service"), *window], "event")
        assert m.get_route_log()[-1]["route"] == "split"
        return out

    @add("SELECT metric, arg_max(value, (time, id)) AS value, service, 'gauge' AS type FROM ev GROUP BY metric, service")
    def latest_stored(spark, sf_dir):
        """By way of a rollup that was declared when the gauges were there."""
        m = filled(spark, sf_dir, now, gauges=True)
        m.store.declare_latest(("service",))
        out = m.find_across_tenants_df([q.group_by("service")], "gauge")
        assert m.get_route_log()[-1]["route"] == "latest"
        return out

    @add(f"SELECT metric, arg_max(value, (time, id)) AS value, service, 'gauge' AS type FROM ev WHERE NOT (tenant = '3' AND {inside}) GROUP BY metric, service")
    def purge_gauges(spark, sf_dir):
        m = filled(spark, sf_dir, now, gauges=True, before=lambda s: s.declare_latest(("service",)))
        m.purge("3", window, "gauge")
        return m.find_across_tenants_df([q.group_by("service")], "gauge")

    @add(by_metric.format(where=""))
    def compacted(spark, sf_dir):
        """Ten appends by the last digit of the id, then one file a month again."""
        m = empty(spark)
        rows = canonical.events(spark, sf_dir)
        missing = [c for c in m.store._schema("events").fieldNames() if c not in rows.columns]
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in missing})
        for k in range(10):
            m.store.append(rows.where(F.substring("id", -1, 1) == str(k)), "event")
        assert m.store.compact(4) > 0
        total = m.sum_daily_df
        assert all(total(t).first()["total"] == reads.total(m.store.read("events"), "event", t, q.Spec(), "sum").first()["total"] for t in ("1", "7"))
        return summed(m)

    @add("SELECT CAST(2 * sum(value) AS BIGINT) AS raw, CAST(2 * sum(value) AS BIGINT) AS daily FROM ev")
    def recovered(spark, sf_dir):
        """A writer dies between the renames of its second append; recovery ends it."""
        m = filled(spark, sf_dir, now)
        move, seen = m.store._move, []

        def dying(source, place):
            if len(seen) == 1:
                raise OSError("lost")
            seen.append(move(source, place))

        rows, m.store._move = m.store.read("events"), dying
        try:
            m.store.append(rows, "event")
        except OSError:
            pass
        m.store._move = move
        assert m.store.pending() and m.tables().events_daily is None
        assert m.store.recover() == 1 and not m.store.pending()
        raw, daily = (m.store.read(n).agg(F.sum("value").alias(c)) for n, c in (("events", "raw"), ("events_daily", "daily")))
        return raw.crossJoin(daily)  # a row each

    # -- reads without a registered query of their own

    def meter(spark, sf_dir, **k) -> Meter:
        return Meter(canonical.frames(spark, sf_dir), now=lambda: now, **k)

    @add(f"SELECT metric, CAST(sum(value) AS BIGINT) AS total FROM ev WHERE tenant = '4' AND {inside} AND metric IN ('click', 'view') GROUP BY metric UNION ALL SELECT metric, arg_max(value, (time, id)) FROM ev WHERE tenant = '4' AND {inside} AND metric = 'error' GROUP BY metric UNION ALL SELECT 'absent', 0")
    def total_of_either_type(spark, sf_dir):
        t = canonical.frames(spark, sf_dir)
        m = Meter(Frames(t.events.where("metric <> 'error'"), t.gauges.where("metric = 'error'")), now=lambda: now)
        got = m.get_total_batch("4", ["click", "view", "error", "absent"], window)
        assert m.get_total("4", "error", window) == got["error"]
        return spark.createDataFrame(list(got.items()), "metric string, total long")

    collection = "(SELECT id, metric, value, time, tenant, service, path, 'event' AS type FROM ev UNION ALL SELECT id, metric, value, time, tenant, service, NULL, 'gauge' FROM ev)"

    @add(f"SELECT id, metric, value, time, tenant, service, path, type FROM {collection} WHERE tenant = '5' AND service = 'svc-1'")
    def collection_scan(spark, sf_dir):
        t = canonical.frames(spark, sf_dir)
        rows = t.events.select("id", "metric", "value", "time", "tenant", "service", "path").withColumn("type", F.lit("event"))
        rows = rows.unionByName(t.gauges.select("id", "metric", "value", "time", "tenant", "service").withColumn("type", F.lit("gauge")), allowMissingColumns=True)
        return Meter(of_collection(rows)).find_df("5", [q.equal("service", "svc-1")]).select("id", "metric", "value", "time", "tenant", "service", "path", "type")

    @add("SELECT id, time, 'event' AS type FROM ev WHERE tenant = '3' ORDER BY time, id LIMIT 40 OFFSET 3")
    def find_merged_limit(spark, sf_dir):
        return meter(spark, sf_dir).find_df("3", [q.order_asc("time"), q.order_asc("id"), q.limit(40), q.offset(3)]).select("id", "time", "type")

    @add("SELECT id, 'event' AS type FROM ev WHERE tenant = '3' AND path LIKE '/view/%'")
    def find_applicable_type(spark, sf_dir):
        """Gauges have no path, so no type means events."""
        return meter(spark, sf_dir).find_df("3", [q.starts_with("path", "/view/")]).select("id", "type")

    def cursor(name: str, where: str, tail: str, clauses: list):
        def f(spark, sf_dir):
            return meter(spark, sf_dir).find_across_tenants_df(clauses, "event").select("id", "country")

        f.__name__ = name
        add(f"SELECT id, country FROM ev WHERE {where} ORDER BY {tail}")(f)

    at, nothing = {"country": "ho", "id": "500"}, {"country": None, "id": "500"}
    cursor("cursor_into_nulls", "country > 'ho' OR country IS NULL OR (country = 'ho' AND id > '500')", "country NULLS LAST, id", [q.order_asc("country"), q.cursor_after(at)])
    cursor("cursor_desc_into_nulls", "country < 'ho' OR country IS NULL OR (country = 'ho' AND id < '500')", "country DESC NULLS LAST, id DESC", [q.order_desc("country"), q.cursor_after(at)])
    cursor("cursor_among_nulls", "country IS NULL AND id > '500'", "id", [q.order_asc("country"), q.cursor_after(nothing)])
    cursor("cursor_before_a_null", "country IS NOT NULL OR id < '500'", "country DESC NULLS FIRST, id DESC LIMIT 300", [q.order_asc("country"), q.cursor_before(nothing), q.limit(300)])

    def rolled(spark, sf_dir, at: datetime, **k) -> Meter:
        from .operators import rollups

        t = canonical.frames(spark, sf_dir)
        t.events_daily = rollups.daily(t.events)
        return Meter(t, now=lambda: at, **k)

    hybrid = [q.greater_than_equal("time", "2024-01-04"), q.less_than("time", "2024-01-22 10:00:00")]
    hybrid_sql = "time >= timestamp '2024-01-04' AND time < timestamp '2024-01-22 10:00:00'"

    @add(f"SELECT metric, CAST(sum(value) AS BIGINT) AS total, true AS found FROM ev WHERE tenant = '4' AND metric IN ('click', 'view') AND {hybrid_sql} GROUP BY metric UNION ALL SELECT 'absent', 0, false")
    def routed_batch_hybrid(spark, sf_dir):
        m = rolled(spark, sf_dir, datetime(2024, 1, 20, 12))
        out = m.totals_df("4", ["click", "view", "absent"], q.parse(hybrid), "event")
        assert m.get_route_log()[-1]["route"] == "hybrid"
        return out

    @add(f"SELECT CAST(sum(value) AS BIGINT) AS routed, CAST(sum(value) AS BIGINT) AS raw, false AS off FROM ev WHERE tenant = '4' AND {hybrid_sql}")
    def dual_read_sampler(spark, sf_dir):
        m = rolled(spark, sf_dir, datetime(2024, 1, 20, 12), sample_rate=1.0)
        m.sum("4", hybrid)
        seen = m.get_route_log()[-1]
        return spark.createDataFrame([(seen["routed"], seen["raw"], seen["off"])], "routed long, raw long, off boolean")

    @add(values("(0, 'hybrid'), (1, 'raw'), (2, 'daily'), (3, 'split')", "n, route").replace("(0,", "(0::BIGINT,"))
    def route_log(spark, sf_dir):
        m = rolled(spark, sf_dir, datetime(2024, 1, 20, 12))
        m.set_next_query_id("first")
        for clauses in (hybrid, [q.equal("service", "svc-1"), *hybrid], [q.greater_than_equal("time", "2024-01-04"), q.less_than("time", "2024-01-06")], [q.greater_than("time", "2024-01-04 01:00"), q.less_than("time", "2024-01-06")]):
            m.sum("4", clauses)
        routes = [x["route"] for x in m.get_route_log()]
        assert m.get_stats() == {"queries": 4, "rows": 4}
        m.clear_route_log()
        assert m.get_route_log() == []
        return spark.createDataFrame(list(enumerate(routes)), "n long, route string")

    @add("SELECT count(*) AS n, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value) FILTER (WHERE metric = 'click') AS BIGINT) AS clicks FROM ev WHERE tenant = '3'")
    def tenant_forwarders(spark, sf_dir):
        mine = meter(spark, sf_dir).for_tenant("3")
        return spark.createDataFrame([(mine.count(kind="event"), mine.sum(), mine.get_total("click", kind="event"))], "n long, total long, clicks long")

    @add(f"SELECT 'click' AS metric, CAST(g AS TIMESTAMP) AS date, CAST(coalesce(v, 0) AS BIGINT) AS value, CAST(sum(v) OVER () AS BIGINT) AS total FROM generate_series(timestamp '2024-01-05', timestamp '2024-01-09', INTERVAL 1 DAY) t(g) LEFT JOIN (SELECT date_trunc('day', time) AS d, sum(value) AS v FROM ev WHERE tenant = '3' AND metric = 'click' AND time >= timestamp '2024-01-05' AND time <= timestamp '2024-01-09 23:59:59' GROUP BY 1) ON d = g")
    def series_by_type(spark, sf_dir):
        """Without a type: events fill with zeros; a metric of no rows likewise."""
        t = canonical.frames(spark, sf_dir)
        m = Meter(Frames(t.events, t.gauges.where("metric = 'none'")), now=lambda: now)
        got = m.get_time_series("3", ["click", "absent"], "1d", "2024-01-05", "2024-01-09 23:59:59")
        assert [p["value"] for p in got["absent"]["data"]] == [0] * 5 and got["absent"]["total"] == 0
        return spark.createDataFrame([("click", p["date"], p["value"], got["click"]["total"]) for p in got["click"]["data"]], "metric string, date timestamp_ntz, value long, total long")

    @add("SELECT id AS \"$id\", metric, value, strftime(time, '%Y-%m-%dT%H:%M:%S') AS time, 'event' AS type FROM (SELECT * FROM ev WHERE tenant = '3' ORDER BY time, id LIMIT 25)")
    def api_rows(spark, sf_dir):
        rows = meter(spark, sf_dir).find("3", [q.order_asc("time"), q.order_asc("id"), q.limit(25)], "event")
        out = [api_row(r) for r in rows]
        assert all(r["time"].endswith("+00:00") for r in out)
        return spark.createDataFrame([(r["$id"], r["metric"], r["value"], r["time"][:19], r["type"]) for r in out], "`$id` string, metric string, value long, time string, type string")

    @add("SELECT true AS healthy, true AS again, true AS samples, count(*) AS events, count(*) AS gauges FROM ev")
    def health(spark, sf_dir):
        m = filled(spark, sf_dir, now, gauges=True)
        a = m.health_check()
        m.setup()
        again = m.health_check()
        rows = m.store.read("events").select(F.lit(1).alias("e"), F.lit(0).alias("g")).union(m.store.read("gauges").select(F.lit(0), F.lit(1)))
        return rows.agg(F.lit(a["healthy"]).alias("healthy"), F.lit(again["healthy"]).alias("again"), F.lit(again["tables"]["samples"]).alias("samples"), F.sum("e").alias("events"), F.sum("g").alias("gauges"))

    # -- the sample ledger through the store

    stream = ("production", "fra", "1", "2", "m1", "g0", "cpu")
    asked = samples.SampleRange(*stream, 0, 99, datetime(2026, 8, 1), datetime(2026, 8, 1, 1, 40))

    def ledger(spark, sf_dir) -> Meter:
        m = empty(spark)
        m.store.append_samples(canonical.samples(spark, sf_dir))
        return m

    mine = "SELECT * FROM sm WHERE member = 'm1' AND sequence BETWEEN 0 AND 99"

    @add(f"SELECT least(count(DISTINCT ingestId), 60) AS entries, count(DISTINCT ingestId) > 60 AS truncated FROM ({mine})")
    def samples_watermark(spark, sf_dir):
        mark = ledger(spark, sf_dir).get_sample_watermark(asked, 60)
        assert mark.matches(asked)
        return spark.createDataFrame([(len(mark.entries), mark.truncated)], "entries long, truncated boolean")

    @add(f""", g AS (SELECT sequence, count(DISTINCT ingestId) AS copies, count(DISTINCT (value, intervalStart, intervalEnd)) AS variants, min(intervalStart) AS a, min(intervalEnd) AS z FROM ({mine}) GROUP BY sequence),
ok AS (SELECT *, lag(sequence, 1, -1) OVER l AS before, lag(z, 1, timestamp '2026-08-01') OVER l AS ended, lead(sequence) OVER l AS following FROM g WHERE variants = 1 WINDOW l AS (ORDER BY sequence))
SELECT (SELECT count(*) FROM ok) AS samples, (SELECT count(*) FROM g WHERE variants > 1) AS conflicts, (SELECT count(*) FILTER (WHERE before + 1 < sequence) + count(*) FILTER (WHERE following IS NULL AND sequence < 99) FROM ok) AS gaps,
(SELECT count(*) FROM ok WHERE a <> ended OR (following IS NULL AND z <> timestamp '2026-08-01 01:40:00')) AS discontinuities, (SELECT CAST(sum(greatest(0, copies - greatest(1, variants))) AS BIGINT) FROM g) AS duplicates, false AS truncated, false AS complete""")
    def samples_found(spark, sf_dir):
        m = ledger(spark, sf_dir)
        r = m.find_samples(asked, m.get_sample_watermark(asked, 10_000), 10_000)
        return spark.createDataFrame([(len(r.samples), len(r.conflicts), len(r.gaps), len(r.discontinuities), r.duplicate_count, r.truncated, r.complete)], "samples long, conflicts long, gaps long, discontinuities long, duplicates long, truncated boolean, complete boolean")

    @add(f""", g AS (SELECT sequence, count(*) AS copies, count(DISTINCT (value, intervalStart, intervalEnd)) AS variants FROM ({mine}) GROUP BY sequence)
SELECT (SELECT CAST(sum(copies) AS BIGINT) FROM g WHERE sequence < 50) AS seen, CAST(sum(copies) AS BIGINT) AS entries, count(*) FILTER (WHERE variants = 1) AS samples, count(*) FILTER (WHERE variants > 1) AS conflicts,
(SELECT count(*) FROM g WHERE variants = 1 AND sequence < 50) AS samples_then, CAST(sum(greatest(0, copies - greatest(1, variants))) AS BIGINT) AS duplicates FROM g""")
    def samples_added(spark, sf_dir):
        """A stream's samples by the client's call, in two parts: what comes after the watermark isn't seen by it."""
        m, names = empty(spark), list(samples.Sample.__dataclass_fields__)
        rows = [samples.Sample(**{n: r[n] for n in names}) for r in samples.in_range(canonical.samples(spark, sf_dir), asked).collect()]
        m.add_samples([x for x in rows if x.sequence < 50])
        mark = m.get_sample_watermark(asked, 10_000)
        m.add_samples([x for x in rows if x.sequence >= 50])
        then, now_ = m.find_samples(asked, mark, 10_000), m.find_samples(asked, later := m.get_sample_watermark(asked, 10_000), 10_000)
        return spark.createDataFrame([(len(mark.entries), len(later.entries), len(now_.samples), len(now_.conflicts), len(then.samples), now_.duplicate_count)], "seen long, entries long, samples long, conflicts long, samples_then long, duplicates long")

    @add(""", r AS (SELECT max(sequence) AS last, max(intervalEnd) AS z FROM sm WHERE member = 'm1'),
g AS (SELECT sequence, count(DISTINCT ingestId) AS copies, count(DISTINCT (value, intervalStart, intervalEnd)) AS variants, min(intervalStart) AS a, min(intervalEnd) AS z FROM sm WHERE member = 'm1' GROUP BY sequence),
ok AS (SELECT *, lag(sequence, 1, -1) OVER l AS before, lag(z, 1, timestamp '2026-08-01') OVER l AS ended, lead(sequence) OVER l AS following FROM g WHERE variants = 1 WINDOW l AS (ORDER BY sequence))
SELECT (SELECT count(*) FROM ok) AS samples, (SELECT count(*) FROM g WHERE variants > 1) AS conflicts, (SELECT count(*) FILTER (WHERE before + 1 < sequence) + count(*) FILTER (WHERE following IS NULL AND sequence < (SELECT last FROM r)) FROM ok) AS gaps,
(SELECT count(*) FROM ok WHERE a <> ended OR (following IS NULL AND z <> (SELECT z FROM r))) AS discontinuities, (SELECT CAST(sum(greatest(0, copies - greatest(1, variants))) AS BIGINT) FROM g) AS duplicates""")
    def samples_stored_watermark(spark, sf_dir):
        """A whole stream by way of a watermark that is a table: the driver has its count and digest."""
        m = ledger(spark, sf_dir)
        ends = m.store.read("samples").where("member = 'm1'").agg(F.max("sequence"), F.max("intervalEnd")).first()
        whole = samples.SampleRange(*stream, 0, ends[0], datetime(2026, 8, 1), ends[1])
        return m.find_sample_frames(whole, m.store_sample_watermark(whole, 1 << 40)).summary()

    # -- what is refused

    def row(**k):
        return {"tenant": "1", "metric": "m", "value": 1} | k

    def sample(**k):
        return samples.Sample(**(dict(zip(("environment", "region", "projectInternalId", "databaseInternalId", "member", "generation"), stream, strict=False)) | {"sequence": 0, "metric": "cpu", "intervalStart": datetime(2026, 8, 1), "intervalEnd": datetime(2026, 8, 1, 0, 1), "value": 1, "eventVersion": 1} | k))

    cases = {
        "batch: no metric": lambda m: m.add_batch([{"tenant": "1", "value": 1}], "event"),
        "batch: empty metric": lambda m: m.add_batch([row(metric="")], "event"),
        "batch: long metric": lambda m: m.add_batch([row(metric="m" * 256)], "event"),
        "batch: no value": lambda m: m.add_batch([{"tenant": "1", "metric": "m"}], "event"),
        "batch: text value": lambda m: m.add_batch([row(value="1")], "event"),
        "batch: boolean value": lambda m: m.add_batch([row(value=True)], "event"),
        "batch: negative value": lambda m: m.add_batch([row(value=-1)], "event"),
        "batch: no tenant": lambda m: m.add_batch([row(tenant="")], "event"),
        "batch: unknown column": lambda m: m.add_batch([row(tags={"colour": "red"})], "event"),
        "batch: event column of a gauge": lambda m: m.add_batch([row(tags={"path": "/"})], "gauge"),
        "batch: bad time": lambda m: m.add_batch([row(time="soon")], "event"),
        "batch: unknown type": lambda m: m.add_batch([row()], "total"),
        "row: long dimension": lambda m: ingest.validate_row({"metric": "m", "value": 1, "country": "deu"}),
        "row: dimension of another type": lambda m: ingest.validate_row({"metric": "m", "value": 1, "path": 7}),
        "query: unknown method": lambda m: m.find("1", [q.Query("regex", "path", ("x",))], "event"),
        "query: unknown attribute": lambda m: m.find("1", [q.equal("colour", "red")], "event"),
        "query: event attribute of a gauge": lambda m: m.find("1", [q.equal("path", "/")], "gauge"),
        "query: no values": lambda m: m.find("1", [q.equal("path", [])], "event"),
        "query: average": lambda m: q.aggregate("avg"),
        "query: minimum": lambda m: q.aggregate("min"),
        "query: interval": lambda m: q.group_by_interval("2h"),
        "query: order of groups by id": lambda m: m.find("1", [q.group_by("path"), q.order_asc("id")], "event"),
        "query: order of groups by time": lambda m: m.find("1", [q.group_by("path"), q.order_asc("time")], "event"),
        "query: negative limit": lambda m: m.find("1", [q.limit(-1)], "event"),
        "tenant: empty": lambda m: m.find("", [], "event"),
        "tenant: none": lambda m: m.find(None, [], "event"),
        "count: groups": lambda m: m.count("1", [q.group_by("path")]),
        "count: negative most": lambda m: m.count("1", [], "event", -1),
        "sum: another attribute": lambda m: m.sum("1", [], "time"),
        "total: of both types": lambda m: m.get_total("1", "click"),
        "cursor: without a type": lambda m: m.find("1", [q.cursor_after({"id": "1"})]),
        "cursor: of groups": lambda m: m.find("1", [q.group_by("path"), q.cursor_after({"id": "1"})], "event"),
        "cursor: lacks a value": lambda m: m.find("1", [q.order_asc("time"), q.cursor_after({"id": "1"})], "event"),
        "cursor: null time": lambda m: m.find("1", [q.order_asc("time"), q.cursor_after({"id": "1", "time": None})], "event"),
        "cursor: a number": lambda m: m.find("1", [q.cursor_after(5)], "event"),
        "daily: attribute": lambda m: m.find_daily("1", [q.equal("path", "/")]),
        "backfill: no midnight": lambda m: m.backfill_daily("2026-06-15 01:00", "2026-06-16"),
        "backfill: inverted": lambda m: m.backfill_daily("2026-06-16", "2026-06-15"),
        "retention: no days": lambda m: m.setup(retention_days=0),
        "rollup: unknown dimension": lambda m: m.store.declare_hourly("city"),
        "accumulator: empty tenant": lambda m: m.accumulator().collect("", "m", 1, "event"),
        "accumulator: negative": lambda m: m.accumulator().collect("1", "m", -1, "event"),
        "sample: empty member": lambda m: sample(member=""),
        "sample: negative sequence": lambda m: sample(sequence=-1),
        "sample: inverted interval": lambda m: sample(intervalEnd=datetime(2026, 8, 1)),
        "sample: event version": lambda m: sample(eventVersion=1 << 32),
        "sample: inverted gap": lambda m: samples.SampleGap(3, 2),
        "sample: limit": lambda m: m.get_sample_watermark(asked, 0),
        "sample: watermark of another range": lambda m: m.find_samples(asked, samples.SampleWatermark(samples.SampleRange(*stream, 0, 1, datetime(2026, 8, 1), datetime(2026, 8, 1, 1, 40)), (), False), 5),
    }

    @add(f"SELECT c.\"case\", true AS refused, metric, n FROM ({values(', '.join(f"('{c}')" for c in cases), '"case"')}) c, (SELECT metric, count(*) AS n FROM ev GROUP BY metric) e")
    def refused(spark, sf_dir):
        """Every case is tried on a store of the events, and leaves its metrics as they were."""
        m, out = filled(spark, sf_dir, now, gauges=True), []
        for name, f in cases.items():
            try:
                f(m)
                out.append((name, False))
            except (ValueError, TypeError):
                out.append((name, True))
        counts = m.store.read("events").groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
        tried = F.explode(F.array(*[F.struct(F.lit(name).alias("case"), F.lit(no).alias("refused")) for name, no in out]))
        return counts.select("metric", "n", tried.alias("c")).select("c.case", "c.refused", "metric", "n")

    return made, sql
