import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gaugeline.engine import Meter
from gaugeline.operators import reads, rollups
from gaugeline.operators.rollups import fold_daily
from gaugeline.plans import query as q
from gaugeline.plans import router
from gaugeline.plans.window import Window
from gaugeline.sources.store import Conflict, Store
from gaugeline.sources.tables import Frames
from gaugeline.streaming.rollup import read_daily, stream_daily

from test_samples import files_read

NOW = datetime(2026, 6, 20, 12)


def row(metric, value, time=None, tenant="1", negative=False, **tags):
    return {"tenant": tenant, "metric": metric, "value": value, "tags": tags, "time": time, "allow_negative": negative}


def fresh(spark, tmp_path, **k):
    u = Meter(Store(spark, str(tmp_path), "ns"), now=lambda: NOW, **k)
    u.setup()
    u.setup()
    return u


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A few events and gauges that the read tests share."""
    u = fresh(spark, tmp_path_factory.mktemp("small"))
    u.add_batch([
        row("requests", 100, "2026-06-01 10:00", region="US-EAST", path="/v1/storage", method="GET", status="200", resourceType="project", resourceId="p1"),
        row("requests", 150, "2026-06-01 11:00", region="us-west", path="/v1/databases", method="POST", status="201", resourceType="database", resourceId="db1"),
        row("bandwidth", 5000, "2026-06-02 10:00", region="us-east", path="/v1/storage/files", method="POST", status="201", resourceType="bucket", resourceId="b1"),
        row("requests", 7, "2026-06-02 10:00", tenant="2", path="cache%hit"),
    ], "event")
    u.add_batch([row("storage", 10000, "2026-06-01", resourceId="p1", ordinal="0"), row("cpu", 2, "2026-06-03 00:00"), row("cpu", 9, "2026-06-03 00:05"), row("cpu", 4, "2026-06-03 00:10"), row("cpu", 6, "2026-06-03 01:05"), row("cpu", 1, "2026-06-03 01:10")], "gauge")
    return u


def test_totals(small):
    assert small.sum("1", [q.equal("metric", "requests")]) == 250
    assert small.get_total("1", "storage", kind="gauge") == 10000
    assert small.get_total_batch("1", ["requests", "bandwidth", "storage", "none"]) == {"requests": 250, "bandwidth": 5000, "storage": 10000, "none": 0}
    assert small.get_total("2", "requests") == 7 and small.get_total("3", "requests") == 0
    assert small.get_total("1", "requests", [q.equal("path", "/v1/storage")]) == 100
    assert small.sum("1", [q.equal("metric", "cpu")], kind="gauge") == 22


def test_find_and_scope(small):
    rows = small.find("1", [q.equal("region", "us-east"), q.order_asc("value")])
    assert [r["value"] for r in rows] == [100, 5000] and {r["type"] for r in rows} == {"event"}
    assert small.find("2", [q.contains("path", "%")], "event")[0]["path"] == "cache%hit"
    assert small.find("2", [q.contains("path", "cache_hit")], "event") == []
    assert len(small.find("1")) == 9 and len(small.find("1", [q.limit(4)])) == 4
    assert small.find("1", [q.limit(3), q.offset(2), q.order_asc("value")])[0]["type"] == "event"
    assert len(small.find_across_tenants([q.equal("metric", "requests")], "event")) == 3
    for bad in ("", None):
        with pytest.raises(ValueError):
            small.find(bad)
    with pytest.raises(ValueError):
        small.find("1", [q.cursor_after({"id": "x"})])
    assert small.for_tenant("2").count() == 1
    with pytest.raises(ValueError):
        small.for_tenant("")


def test_counts(small):
    assert small.count("1") == 9 and small.count("1", most=5) == 5 and small.count("1", kind="event") == 3
    with pytest.raises(ValueError):
        small.count("1", [q.group_by("path")])
    with pytest.raises(ValueError):
        small.sum("1", [q.aggregate("max")])


def test_gauge_aggregates(small):
    cpu = [q.equal("metric", "cpu")]
    hourly = [*cpu, q.group_by_interval("1h")]
    assert [r["value"] for r in small.find("1", hourly, "gauge")] == [4, 1]
    assert [r["value"] for r in small.find("1", [*hourly, q.aggregate("max")], "gauge")] == [9, 6]
    assert [r["value"] for r in small.find("1", [*cpu, q.aggregate("max")], "gauge")] == [9]


def test_cursor_pages_cover_everything(small):
    order = [q.order_desc("metric"), q.order_asc("value"), q.limit(2)]
    seen, cursor = [], None
    while page := small.find("1", [*order, q.cursor_after(cursor)], "gauge"):
        seen += page
        cursor = page[-1]
    assert [(r["metric"], r["value"]) for r in seen] == [("storage", 10000), ("cpu", 1), ("cpu", 2), ("cpu", 4), ("cpu", 6), ("cpu", 9)]
    back = small.find("1", [*order, q.cursor_before(seen[4])], "gauge")
    assert [r["value"] for r in back] == [2, 4]
    with pytest.raises(ValueError, match="lacks"):
        small.find("1", [q.order_asc("value"), q.cursor_after({"id": "x"})], "gauge")
    with pytest.raises(ValueError, match="null"):
        small.find("1", [q.order_asc("value"), q.cursor_after({"id": "x", "value": None})], "gauge")


def test_series_fill(spark, tmp_path):
    u = fresh(spark, tmp_path)
    u.add_batch([row("disk", 100, "2026-06-01 02:00"), row("disk", 300, "2026-06-01 08:00")], "gauge")
    u.add_batch([row("calls", 50, "2026-06-01 01:00"), row("late", 5, "2026-06-01 02:10")], "event")
    got = u.get_time_series("1", ["disk"], "1h", "2026-06-01", "2026-06-01 10:00", kind="gauge")["disk"]
    assert [p["value"] for p in got["data"]] == [0, 0] + [100] * 6 + [300] * 3 and got["total"] == 400
    got = u.get_time_series("1", ["calls", "none"], "1h", "2026-06-01", "2026-06-01 04:00")
    assert [p["value"] for p in got["calls"]["data"]] == [0, 50, 0, 0, 0] and got["none"]["total"] == 0 and len(got["none"]["data"]) == 5
    # a partial last step has no label but counts
    got = u.get_time_series("1", ["late"], "1h", "2026-06-01 00:37", "2026-06-01 02:14")["late"]
    assert [p["date"].hour for p in got["data"]] == [0, 1] and got["total"] == 5
    df = u.time_series_df("1", ["disk"], "1h", "2026-06-01", "2026-06-01 10:00", kind="gauge").orderBy("bucket")
    assert [r["value"] for r in df.collect()] == [0, 0] + [100] * 6 + [300] * 3
    with pytest.raises(ValueError):
        u.get_time_series("1", ["late"], "1w", "2026-06-01", "2026-06-02")


def test_write_checks(spark, tmp_path):
    u = fresh(spark, tmp_path)
    for bad in (row("", 1), row("m" * 256, 1), row("m", -1), row("m", 1, tenant=""), {"metric": "m", "value": 1}, {"tenant": "1", "value": 1}, {"tenant": "1", "metric": "m"}, row("m", 1, colour="red")):
        with pytest.raises((ValueError, TypeError)):
            u.add_batch([row("fine", 1), bad], "event")
    for bad in (row("m", 1.5), row("m", True), row(5, 1)):
        with pytest.raises(TypeError):
            u.add_batch([bad], "event")
    with pytest.raises(ValueError):
        u.add_batch([row("m", 1)], "total")
    with pytest.raises(ValueError, match="path"):
        u.add_batch([row("m", 1, path="/x")], "gauge")
    assert u.count("1") == 0
    u.add_batch([row("0", -3, negative=True, country="DE", path="", status=200, ordinal=10, ip=None, hostname='tab\t"quote" 🙂\n')], "event")
    got = u.find("1", kind="event")[0]
    assert (got["metric"], got["value"], got["country"], got["path"], got["status"], got["ordinal"], got["hostname"], got["time"]) == ("0", -3, "de", None, "200", "10", 'tab\t"quote" 🙂\n', NOW)


def test_ordinals_fold_in_the_daily_rollup(spark, tmp_path):
    u = fresh(spark, tmp_path)
    u.add_batch([row("storage", 512, "2026-06-01 09:00", ordinal="0", resourceId="r"), row("storage", 128, "2026-06-01 10:00", ordinal="1", resourceId="r"), row("storage", 5, "2026-06-02")], "event")
    by = u.find("1", [q.group_by("ordinal"), q.order_asc("ordinal")], "event")
    assert [(r["ordinal"], r["value"]) for r in by] == [("0", 512), ("1", 128), (None, 5)]
    day = [q.greater_than_equal("time", "2026-06-01"), q.less_than("time", "2026-06-02")]
    assert [r["value"] for r in u.find_daily("1", day)] == [640]
    assert u.sum_daily("1", day) == 640 and u.sum_daily_batch("1", ["storage", "none"]) == {"storage": 645, "none": 0}
    for bad in ([q.equal("id", "x")], [q.equal("path", "x")], [q.group_by("resourceId")]):
        with pytest.raises(ValueError):
            u.find_daily("1", bad)


def test_backfill(spark, tmp_path):
    u = fresh(spark, tmp_path)
    raw = u.store
    rows = [row("m", 100, "2026-06-15 05:00"), row("m", 200, "2026-06-17 23:59:59"), row("other", 40, "2026-06-16")]
    from gaugeline.operators.ingest import to_frame

    raw.append_raw(to_frame(spark, rows, "event", NOW))
    span = [q.greater_than_equal("time", "2026-06-15"), q.less_than("time", "2026-06-18")]
    assert u.sum("1", [q.equal("metric", "m"), *span]) == 300 and u.get_route_log()[-1]["route"] == "raw"
    assert u.sum_daily("1", span) == 0
    for a, b in (("2026-06-15", "2026-06-15"), ("2026-06-16", "2026-06-15"), ("2026-06-15 01:00", "2026-06-16"), ("2026-06-15T00:00:00+02:00", "2026-06-16")):
        with pytest.raises(ValueError):
            u.backfill_daily(a, b)
    u.backfill_daily("2026-06-15", "2026-06-18")
    assert u.sum("1", [q.equal("metric", "m"), *span]) == 300 and u.get_route_log()[-1]["route"] == "daily"
    assert u.sum_daily("1", [q.equal("metric", "other"), *span]) == 40
    with pytest.raises(ValueError):
        u.backfill_daily("2026-06-16", "2026-06-19")
    u.backfill_daily("2026-06-16", "2026-06-19", force=True)
    assert u.sum_daily("1", span) == 340


def test_purge_keeps_rollups_exact(spark, tmp_path):
    u = fresh(spark, tmp_path)
    u.store.declare_hourly("service")
    u.store.declare_latest(("service",))
    u.add_batch([row("a", 100, "2026-05-30 10:00", path="/x", service="s"), row("a", 7, "2026-05-30 12:00", path="/y", service="s"), row("b", 100, "2026-06-01", path="/y"), row("a", 1, "2026-06-01", tenant="2", path="/x")], "event")
    u.add_batch([row("g", 3, "2026-05-01", service="s"), row("g", 9, "2026-06-02", service="s")], "gauge")
    u.purge("1", [q.equal("path", "/x"), q.order_asc("time"), q.limit(1)])
    assert u.sum("1", [q.less_than("time", "2026-06-05")]) == 107 and u.get_route_log()[-1]["route"] == "daily"
    assert u.sum_daily("2") == 1 and u.get_total("1", "g") == 9
    assert [(r["service"], r["value"]) for r in u.find("1", [q.group_by("service"), q.equal("metric", "a")], "event")] == [("s", 7)] and u.get_route_log()[-1]["route"] == "hourly"
    latest = [q.group_by("service")]
    assert [r["value"] for r in u.find("1", latest, "gauge")] == [9] and u.get_route_log()[-1]["route"] == "latest"
    u.purge("1", [q.greater_than("time", "2026-06-01")], "gauge")
    assert [r["value"] for r in u.find("1", latest, "gauge")] == [3]
    u.purge("1")
    assert u.count("1") == 0 and u.sum_daily("1") == 0 and u.find("1", latest, "gauge") == [] and u.count("2") == 1


def test_retention_and_migration(spark, tmp_path):
    u = fresh(spark, tmp_path)
    u.add_batch([row("m", 1, "2026-01-05"), row("m", 2, "2026-05-31 11:00"), row("m", 4, "2026-05-31 13:00"), row("m", 8, "2026-06-19")], "event")
    u.apply_retention(20)
    assert u.sum("1") == 12 and u.sum_daily("1") == 12
    u.migrate()
    assert u.sum("1") == 12 and u.count("1") == 2
    assert u.health_check()["healthy"]


def test_tables_not_shared(spark, tmp_path):
    u = Meter(Store(spark, str(tmp_path)), shared=False, now=lambda: NOW)
    u.setup()
    u.add_batch([{"metric": "m", "value": 5}], "event")
    assert u.sum(None) == 5 and u.count("ignored") == 1
    with pytest.raises(ValueError):
        u.find_across_tenants([])


def test_ambiguous_metric(spark, tmp_path):
    u = fresh(spark, tmp_path)
    u.add_batch([row("m", -5, "2026-06-01", negative=True)], "event")
    u.add_batch([row("m", 5, "2026-06-01")], "gauge")
    with pytest.raises(ValueError, match="type"):
        u.get_total("1", "m")
    assert u.get_total("1", "m", kind="event") == -5


def dense(spark):
    """40 days with rows at each midnight, in the morning and in the last microsecond, four an hour on some."""
    rows, n = [], 0
    for day in range(40):
        start = datetime(2026, 5, 12) + timedelta(days=day)
        times = [start, start + timedelta(hours=9, minutes=15), start + timedelta(days=1, microseconds=-1), start + timedelta(hours=12)]
        if day % 9 == 0:
            times += [start + timedelta(hours=h, minutes=15 * k + 7, seconds=k, milliseconds=k * 11) for h in range(24) for k in range(4)]
        for t in times:
            rows.append((f"{n:05d}", "ab"[n % 5 == 0], n * 7 % 101, t, "12"[n % 3 == 0], f"s{n % 4}" if n % 7 else None, f"r{n % 3}"))
            n += 1
    return spark.createDataFrame(rows, "id string, metric string, value long, time timestamp_ntz, tenant string, service string, resourceId string")


def test_routes_equal_raw(spark):
    ev = dense(spark).cache()
    daily, hourly = rollups.daily(ev).cache(), {"service": rollups.hourly(ev, "service").cache()}
    from gaugeline.sources.tables import Frames

    routed = Meter(Frames(ev, ev, daily, hourly), now=lambda: NOW)
    rng, labels = random.Random(8), set()
    edges = [datetime(2026, 5, 12) + timedelta(days=d) + x for d in (0, 3, 9, 18, 38, 39) for x in (timedelta(0), timedelta(hours=9, minutes=15), timedelta(microseconds=-1), timedelta(hours=12, minutes=37, seconds=21, milliseconds=456))]
    for i in range(26):
        a, b = sorted(rng.sample(edges, 2))
        low, high = rng.choice([q.greater_than, q.greater_than_equal]), rng.choice([q.less_than, q.less_than_equal])
        window = [low("time", a), high("time", b)] if i % 4 else [q.between("time", a, b)]
        clauses = [*window, *([q.equal("resourceId", "r1")] if i % 3 == 0 else [])]
        spec = q.parse(clauses)
        want = reads.total(ev, "event", "1", spec, "sum").first()["total"]
        assert routed.sum("1", clauses) == want, clauses
        labels.add(routed.get_route_log()[-1]["route"])
        grouped = [*window, q.group_by("service"), *([q.group_by_interval(rng.choice(["1h", "1d", "1w", "1M"]))] if i % 2 else [])]
        plain = reads.find_grouped(ev, "event", "1", q.parse(grouped)).collect()
        assert routed.find_df("1", grouped, "event").drop("type").collect() == plain, grouped
        labels.add("g:" + routed.get_route_log()[-1]["route"])
    assert {"daily", "hybrid", "split", "raw", "g:split"} <= labels | {"daily"} and "split" in labels and "hybrid" in labels


def test_dual_read_sampler(spark):
    ev = dense(spark)
    from gaugeline.sources.tables import Frames

    u = Meter(Frames(ev, ev, rollups.daily(ev)), now=lambda: NOW, sample_rate=1.0)
    u.sum("1", [q.less_than("time", "2026-06-01")])
    assert u.get_route_log()[-1]["operation"] == "sample" and not u.get_route_log()[-1]["off"]
    u.clear_route_log()
    assert u.get_route_log() == []


def test_plans_push_filters(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # else the plan's text is cut
    u = fresh(spark, tmp_path)
    u.add_batch([row("m", 1, "2026-06-01 10:30", service="s")], "event")
    plan = reads.total(u.store.read("events"), "event", "1", q.parse([q.equal("metric", "m"), q.greater_than_equal("time", "2026-06-01")]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time" in plan and "EqualTo(tenant,1)" in plan
    assert "month" in plan.split("PartitionFilters:")[1].split("]")[0] and "2026-06" in plan.split("PartitionFilters:")[1].split("]")[0]
    schema = plan.split("ReadSchema:")[1]
    assert "path" not in schema and "value" in schema
    capped = reads.count_rows(u.store.read("events"), "event", "1", q.parse([]), 10)._jdf.queryExecution().executedPlan().toString()
    assert "LocalLimit" in capped


def test_accumulator(spark, tmp_path):
    u = fresh(spark, tmp_path)
    a = u.accumulator()
    t = datetime(2026, 6, 1, 12, 5)
    a.collect("1", "m", 1, "event", {"path": "/x", "method": "GET"}, t).collect("1", "m", -3, "event", {"method": "GET", "path": "/x"}, t - timedelta(minutes=5), True)
    a.collect("a", "b:c", 1, "event").collect("a:b", "c", 1, "event")
    a.collect("1", "g", 1, "gauge").collect("1", "g", 2, "gauge")
    assert a.count() == 4
    for bad in (("", "m", 1, "event"), ("1", "", 1, "event"), ("1", "m", -1, "event"), ("1", "m", 1, "x")):
        with pytest.raises(ValueError):
            a.collect(*bad)
    assert a.flush() and a.count() == 0
    got = u.find("1", kind="event")[0]
    assert (got["value"], got["time"]) == (-2, t - timedelta(minutes=5)) and u.get_total("1", "g") == 2


def test_accumulator_retry():
    class Flaky:
        def __init__(self):
            self.batches, self.fail = [], {2}

        def add_batch(self, metrics, kind, size):
            self.calls = getattr(self, "calls", 0) + 1
            if self.calls in self.fail:
                raise OSError("lost")
            self.batches.append([m["metric"] for m in metrics])
            return True

    from gaugeline.operators.ingest import Accumulator

    u = Flaky()
    a = Accumulator(u)
    for i in range(2500):
        a.collect("1", f"m{i}", 1, "event")
    with pytest.raises(OSError):
        a.flush()
    assert a.count() == 1500
    assert a.flush() and a.count() == 0
    assert sorted(x for b in u.batches for x in b) == sorted(f"m{i}" for i in range(2500)) and max(map(len, u.batches)) == 1000


def test_stream_equals_batch(spark, tmp_path):
    ev = dense(spark).withColumn("ordinal", F.lit("0"))
    for k in range(3):
        ev.where(f"cast(id as int) % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_daily(source, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    stream_daily(source, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    key = lambda r: tuple(map(str, r))
    got = read_daily(spark, f"{tmp_path}/out")
    assert sorted(map(key, got.collect())) == sorted(map(key, rollups.daily(ev).select(*got.columns).collect()))


def test_fold_and_normalise_columns(spark):
    from gaugeline.operators.ingest import columns_of, fold, normalised, validate_row

    df = spark.createDataFrame([("1", "m", 1, datetime(2026, 6, 2), "1", "DE"), ("2", "m", -4, datetime(2026, 6, 1), "1", "DE"), ("3", "m", 7, datetime(2026, 6, 1), "1", "")], "id string, metric string, value long, time timestamp_ntz, tenant string, country string")
    folded = fold(df.withColumn("country", normalised("country", F.col("country")))).orderBy("value").collect()
    assert [(r["country"], r["value"], r["time"]) for r in folded] == [("de", -3, datetime(2026, 6, 1)), (None, 7, datetime(2026, 6, 1))]
    got = columns_of({"status": True, "service": False, "path": 1.0, "ip": [1], "region": "EU"}, "event")
    assert (got["status"], got["service"], got["path"], got["ip"], got["region"], len(got)) == ("1", "", "1", None, "eu", 47)
    validate_row({"metric": "m", "value": 1, "time": "2026-06-01", "path": "x" * 1024})
    for bad in ({"value": 1}, {"metric": "m", "value": 1, "country": "deu"}, {"metric": "m", "value": 1, "time": "soon"}, {"metric": "m", "value": 1, "method": "é" * 9}):
        with pytest.raises(ValueError):
            validate_row(bad)
    for bad in ({"metric": "m", "value": "1"}, {"metric": 1, "value": 1}):
        with pytest.raises(TypeError):
            validate_row(bad)


def test_rendered_rows():
    from gaugeline.functions.render import api_row

    assert api_row({"id": "7", "time": datetime(2026, 6, 1, 2, 3, 4, 5000)}) == {"$id": "7", "time": "2026-06-01T02:03:04.005+00:00"}
    assert api_row({"time": datetime(2026, 6, 1)}, "1h") == {"time": "2026-06-01T00:00:00+00:00"}
    assert api_row({"time": datetime(2026, 6, 1)}, "1M") == {"time": "2026-06-01+00:00"}


def test_bulk_load(spark, tmp_path):
    from gaugeline.sources import ndjson

    (tmp_path / "in.json").write_text('{"metric":"m","value":5,"time":"2026-06-01T10:00:00","tenant":"1","country":"DE","path":""}\n{"metric":"m","value":7,"tenant":"1"}\n')
    u = fresh(spark, tmp_path / "store")
    df = ndjson.read(spark, str(tmp_path / "in.json"), "event")
    u.add_frame(df, "event")
    got = u.find("1", [q.order_asc("value")], "event")
    assert [(r["value"], r["country"], r["path"], r["time"]) for r in got] == [(5, "de", None, datetime(2026, 6, 1, 10)), (7, None, None, NOW)]
    assert len({r["id"] for r in got}) == 2 and u.sum_daily("1") == 12
    for bad in (df.withColumn("value", F.lit(-1)), df.withColumn("metric", F.lit("")), df.withColumn("tenant", F.lit(None).cast("string")), df.drop("value"), df.withColumn("colour", F.lit("red")), df.withColumn("metric", F.repeat(F.lit("m"), 256))):
        with pytest.raises(ValueError):
            u.add_frame(bad, "event")
    assert u.count("1") == 2 and u.get_stats()["queries"] >= 3
    u.add_frame(df.withColumn("value", F.lit(-1)).select("metric", "value", "tenant"), "gauge", allow_negative=True)
    assert u.get_total("1", "m", kind="gauge") == -1


@pytest.mark.parametrize("kind", ["append", "purge"])
def test_interrupted_writers(spark, tmp_path, kind):
    """A writer that dies before or after any rename leaves a store that sums right, then and once recovered."""
    step, done = 0, False
    while not done:
        u = fresh(spark, tmp_path / f"{kind}{step}")
        u.store.declare_hourly("service")
        u.add_batch([row("m", 1, "2026-05-03", service="s"), row("m", 2, "2026-05-04", path="/x"), row("m", 4, "2026-06-05", path="/x")], "event")
        move, seen = u.store._move, []

        def dying(source, place, u=u, move=move, seen=seen, step=step):
            if len(seen) == step:
                raise OSError("lost")
            move(source, place)
            seen.append(place)

        u.store._move = dying
        try:
            u.add_batch([row("m", 8, "2026-05-03"), row("m", 16, "2026-06-06")], "event") if kind == "append" else u.purge("1", [q.equal("path", "/x")], "event")
            done = True
        except OSError:
            pass
        u.store._move = move
        want = 31 if kind == "append" else 1
        if not done:
            assert u.store.pending() and [u.tables().events_daily, u.tables().hourly] == [None, {}]
            assert u.sum("1", [q.less_than("time", "2026-06-10")]) == u.store.read("events").agg(F.coalesce(F.sum("value"), F.lit(0))).first()[0]
            assert u.store.recover() == 1
        span = [q.greater_than_equal("time", "2026-05-01"), q.less_than("time", "2026-06-10")]
        assert u.sum("1", span) == want and u.get_route_log()[-1]["route"] == "daily" and u.sum_daily("1") == want
        assert sum(r["value"] for r in u.find("1", [q.group_by("service"), *span], "event")) == want and u.get_route_log()[-1]["route"] == "hourly"
        step += 1
    assert step > 4


def test_uncommitted_change_is_dropped(spark, tmp_path):
    u = fresh(spark, tmp_path)
    u.add_batch([row("m", 1, "2026-05-03")], "event")
    put = u.store._put
    u.store._put = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        u.add_batch([row("m", 2, "2026-05-03")], "event")
    u.store._put = put
    u.setup()
    assert u.sum("1") == u.sum_daily("1") == 1 and not u.store.exists("_staged")


def test_pages_over_nulls(spark, tmp_path):
    u = fresh(spark, tmp_path)
    u.add_batch([row("m", i, "2026-05-03", path=p) for i, p in enumerate(["/b", None, "/a", None, "/c", None])], "event")
    for order, names in ((q.order_asc, ["/a", "/b", "/c", None, None, None]), (q.order_desc, ["/c", "/b", "/a", None, None, None])):
        seen, cursor = [], None
        while page := u.find("1", [order("path"), q.limit(2), q.cursor_after(cursor)], "event"):
            seen += page
            cursor = page[-1]
        assert [r["path"] for r in seen] == names and len({r["id"] for r in seen}) == 6
        back, cursor = [], seen[-1]
        while page := u.find("1", [order("path"), q.limit(2), q.cursor_before(cursor)], "event"):
            back = page + back
            cursor = page[0]
        assert [r["id"] for r in back] == [r["id"] for r in seen[:-1]]


# -- several writers


def other(spark, u):
    return Store(spark, u.store.path)


def test_setup_beside_a_writer_loses_nothing(spark, tmp_path):
    """A boot between another writer's staging and its commit is harmless."""
    u = fresh(spark, tmp_path)
    u.add_batch([row("m", 1, "2026-05-03")], "event")
    commit = u.store._commit
    u.store._commit = lambda *a, **k: (other(spark, u).setup(), other(spark, u).recover(), commit(*a, **k))
    assert u.add_batch([row("m", 2, "2026-05-04")], "event")
    assert u.sum("1") == u.sum_daily("1") == 3
    u.purge("1", [q.equal("time", "2026-05-03")], "event")
    assert u.count("1") == 1 and u.sum("1") == u.sum_daily("1") == 2


def test_a_change_without_its_draft_is_refused(spark, tmp_path):
    """Whoever deletes what is staged makes the commit fail; nothing in place is touched."""
    u = fresh(spark, tmp_path)
    u.add_batch([row("m", 1, "2026-05-03", path="/x"), row("m", 2, "2026-05-04")], "event")
    commit = u.store._commit

    def robbed(*a, **k):
        assert other(spark, u).recover(lease=-5) == 0
        return commit(*a, **k)

    u.store._commit = robbed
    for change in (lambda: u.add_batch([row("m", 4, "2026-05-04")], "event"), lambda: u.purge("1", [q.equal("path", "/x")], "event")):
        with pytest.raises(Conflict):
            change()
        assert u.count("1") == 2 and u.sum("1") == u.sum_daily("1") == 3 and not u.store.pending() and not u.store.exists("_staged")


def test_a_lost_file_of_a_committed_change_is_an_error(spark, tmp_path):
    u = fresh(spark, tmp_path)
    u.add_batch([row("m", 1, "2026-05-03"), row("m", 2, "2026-06-04")], "event")
    move = u.store._move
    u.store._move = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        u.add_batch([row("m", 4, "2026-06-04")], "event")
    u.store._move = move
    u.store._forget(f"_staged/{u.store.pending()[0].removesuffix('.json')}")
    with pytest.raises(Conflict):
        u.store.recover()
    assert u.sum("1") == 3


def test_two_rewrites_of_a_file(spark, tmp_path):
    """Of two purges that have read the same file, the second is refused and can be tried again."""
    u = fresh(spark, tmp_path)
    u.add_batch([row("m", 1, "2026-05-03", path="/x"), row("m", 2, "2026-05-03", path="/y"), row("m", 4, "2026-05-03")], "event")
    commit, second = u.store._commit, Meter(other(spark, u), now=lambda: NOW)
    u.store._commit = lambda *a, **k: (second.purge("1", [q.equal("path", "/y")], "event"), commit(*a, **k))
    with pytest.raises(Conflict):
        u.purge("1", [q.equal("path", "/x")], "event")
    u.store._commit = commit
    assert u.sum("1") == u.sum_daily("1") == 5
    u.purge("1", [q.equal("path", "/x")], "event")
    assert u.sum("1") == u.sum_daily("1") == 4


# -- deletes and migrations by file


def test_purge_rewrites_hit_files_only(spark, tmp_path):
    u = fresh(spark, tmp_path)
    u.store.declare_hourly("service")
    for k, month in enumerate(("03", "04", "05", "05", "06")):
        u.add_batch([row("m", 1 << (2 * k), f"2026-{month}-03", path=f"/{k}", service="s"), row("m", 2 << (2 * k), f"2026-{month}-04", service="t")], "event")
    before = {n: set(u.store._files_in(n)) for n in u.store.names()}
    went = u.store.delete("event", F.col("path") == "/2")
    after = {n: set(u.store._files_in(n)) for n in u.store.names()}
    assert went["events"] == 1 and len(before["events"] - after["events"]) == 1 and len(after["events"] & before["events"]) == 4
    # the third of May is in the two rollup files of May's appends
    assert went["events_daily"] == went["events_hourly_service"] == 2
    assert all(f.startswith("month=2026-05") for n in after for f in before[n] ^ after[n])
    left = sum(1 << i for i in range(10)) - (1 << 4)
    assert u.sum("1", [q.less_than("time", "2026-06-10")]) == left and u.sum_daily("1") == left
    assert {r["service"]: r["value"] for r in u.find("1", [q.group_by("service"), q.less_than("time", "2026-06-10")], "event")} == {"s": sum(1 << 2 * k for k in range(5)) - 16, "t": sum(2 << 2 * k for k in range(5))}
    assert u.store.delete("event", F.col("path") == "/nowhere") == {}


def test_latest_values_after_deletes_touch_hit_keys_only(spark, tmp_path):
    u = fresh(spark, tmp_path)
    for d in (("service",), ("resourceType", "resourceId")):
        u.store.declare_latest(d)
    u.add_batch([row("g", 1, "2026-03-01", service="s"), row("g", 2, "2026-03-02", service="t"), row("g", 8, "2026-03-09")], "gauge")
    u.add_batch([row("g", 3, "2026-04-01", service="s"), row("g", 4, "2026-04-02", service="t")], "gauge")
    u.add_batch([row("g", 5, "2026-05-01", service="s"), row("g", 6, "2026-05-01 12:00", service="s", resourceId="r")], "gauge")
    name = "gauges_latest_service"
    before = set(u.store._files_in(name))
    went = u.store.delete("gauge", (F.col("value") >= 5) & (F.col("value") < 7))  # the latest rows of s, in May
    assert went["gauges"] == went[name] == 1
    assert all(f.startswith(("month=2026-05", "month=2026-04")) for f in before ^ set(u.store._files_in(name)))
    latest = [q.group_by("service")]
    assert {r["service"]: r["value"] for r in u.find("1", latest, "gauge")} == {"s": 3, "t": 4, None: 8} and u.get_route_log()[-1]["route"] == "latest"
    before = {n: set(u.store._files_in(n)) for n in u.store.names()}
    assert u.store.delete("gauge", (F.col("value") == 1)) == {"gauges": 1, name: 1}  # a row that its append's rollup has
    assert {r["service"]: r["value"] for r in u.find("1", latest, "gauge")} == {"s": 3, "t": 4, None: 8}
    u.purge("1", [q.is_null("service")], "gauge")
    assert {r["service"]: r["value"] for r in u.find("1", latest, "gauge")} == {"s": 3, "t": 4}


def test_random_deletes_keep_rollups_exact(spark, tmp_path):
    rng = random.Random(6)
    u = fresh(spark, tmp_path)
    u.store.declare_hourly("service")
    u.store.declare_latest(("service",))
    for _ in range(3):
        rows = [row(rng.choice("ab"), rng.randrange(9), f"2026-0{rng.randrange(3, 6)}-0{rng.randrange(1, 4)} 0{rng.randrange(3)}:00", service=rng.choice(["s", "t", None]), tenant=rng.choice("12")) for _ in range(40)]
        u.add_batch(rows, "event")
        u.add_batch(rows, "gauge")
    for condition in (F.col("value") == 3, (F.col("tenant") == "1") & F.col("service").isNull(), F.col("time") >= "2026-05-02", None):
        for kind in ("event", "gauge"):
            u.store.delete(kind, condition)
        ev, g = u.store.read("events"), u.store.read("gauges")
        for have, want in ((fold_daily(u.store.read("events_daily").drop("month")), rollups.daily(ev)), (fold_daily(u.store.read("events_hourly_service").drop("month")), rollups.hourly(ev, "service")), (rollups.latest(u.store.read("gauges_latest_service"), ("service",)), rollups.latest(g, ("service",)))):
            assert sorted(map(str, have.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_migration_writes_what_differs_only(spark, tmp_path):
    u = fresh(spark, tmp_path)
    u.add_batch([row("m", 1, "2026-05-03"), row("m", 2, "2026-06-04")], "event")
    before = {n: set(u.store._files_in(n)) for n in u.store.names()}
    u.migrate()
    assert {n: set(u.store._files_in(n)) for n in u.store.names()} == before
    # a file from before some dimensions, and one of an older type
    old = u.store.read("events").where("value = 1").drop("month", "sdk", "city")
    old.withColumn("value", F.lit(4)).write.mode("append").parquet(u.store._at("events/month=2026-05"))
    old.withColumn("value", F.lit(8).cast("bigint")).write.mode("append").parquet(u.store._at("events/month=2026-05"))
    assert u.store.migrate("events") == 1
    assert len(before["events"] - set(u.store._files_in("events"))) == 0
    assert u.count("1") == 4 and u.store.read("events").agg(F.sum("value")).first()[0] == 15
    assert u.store.migrate("events") == 0


# -- routes by cost, listings by version


def test_rows_within_a_window():
    counts = {"2024-01": 3100, "2024-02": 2900, "2024-12": 31}
    assert router.rows_within(counts, Window()) == 6031
    assert router.rows_within(counts, Window(datetime(2024, 1, 11), datetime(2024, 2, 11))) == pytest.approx(2100 + 1000)
    assert router.rows_within(counts, Window(datetime(2024, 12, 31), None)) == pytest.approx(1)
    assert router.rows_within(counts, Window(datetime(2025, 1, 1), None)) == router.rows_within({}, Window()) == 0


@pytest.mark.parametrize(("size", "sums", "groups"), [(1, "raw", "raw"), (10**8, "hybrid", "split")])
def test_routes_by_cost(spark, size, sums, groups):
    rows = spark.range(200).selectExpr("cast(id as string) as id", "'m' as metric", "id as value", "timestampadd(HOUR, cast(id as int), timestamp_ntz'2026-06-12 00:30:00') as time", "'1' as tenant", "'s' as service")
    t = Frames(rows, rows, rollups.daily(rows), {"service": rollups.hourly(rows, "service")})
    t.rows = {"events": {"2026-06": 20 * size}, "events_daily": {"2026-06": size}, "events_hourly_service": {"2026-06": 2 * size}}
    u = Meter(t, now=lambda: NOW, by_cost=True)
    window = [q.greater_than_equal("time", "2026-06-13"), q.less_than("time", "2026-06-20 11:30")]
    plain = Meter(Frames(rows, rows), now=lambda: NOW)
    assert u.sum("1", window) == plain.sum("1", window)
    assert u.get_route_log()[-1]["route"] == sums and u.get_route_log()[-1]["rows"] > 0
    by = [q.group_by("service"), *window]
    assert u.find("1", by, "event") == plain.find("1", by, "event")
    assert u.get_route_log()[-1]["route"] == groups
    t.rows = {}
    u.sum("1", window)
    assert u.get_route_log()[-1]["route"] == "hybrid" and "rows" not in u.get_route_log()[-1]


def test_counts_come_from_the_store(spark, tmp_path):
    u = fresh(spark, tmp_path, by_cost=True)
    u.store.declare_hourly("service")
    assert u.store.row_counts(0) == {}
    u.add_batch([row("m", 1, "2026-05-03", service="s"), row("m", 2, "2026-05-03", service="s"), row("m", 4, "2026-06-05")], "event")
    assert u.store.row_counts(0) == {"events": {"2026-05": 2, "2026-06": 1}, "events_daily": {"2026-05": 1, "2026-06": 1}, "events_hourly_service": {"2026-05": 1, "2026-06": 1}}
    assert u.sum("1", [q.less_than("time", "2026-06-10 01:00")]) == 7 and u.get_route_log()[-1]["route"] == "raw"


def test_files_are_listed_once_a_version(spark, tmp_path):
    u = fresh(spark, tmp_path)
    u.add_batch([row("m", 1, "2026-05-03")], "event")
    first = u.tables()
    assert u.tables() is first
    Meter(other(spark, u), now=lambda: NOW).add_batch([row("m", 2, "2026-05-03")], "event")
    assert u.tables() is not first and u.sum("1") == u.sum_daily("1") == 3
    second = u.tables()
    u.store.declare_hourly("service")
    assert list(u.tables().hourly) == ["service"] and second.hourly == {}
    u.purge("1", [q.equal("value", 2)], "event")
    assert u.sum("1") == 1


# -- streams into the store


def test_stream_into_store_survives_restarts(spark, tmp_path):
    """A batch whose writer dies, before or after its commit, is there once when the stream goes on."""
    ev = dense(spark)
    for k in range(4):
        ev.where(f"cast(id as int) % 4 = {k}").drop("id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(ev.drop("id").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    u = fresh(spark, tmp_path / "store")
    u.store.declare_hourly("service")
    move, forget, deaths = u.store._move, u.store._forget, []

    def dying_move(a, b):
        if len(deaths) == 0 and "events_daily" in b:
            deaths.append("between renames")
            raise OSError("lost")
        move(a, b)

    def dying_forget(name, **k):
        if len(deaths) == 1 and name.startswith("_pending"):
            deaths.append("before the record goes")
            raise OSError("lost")
        forget(name, **k)

    u.store._move, u.store._forget = dying_move, dying_forget
    for _ in range(3):
        try:
            u.add_stream(source, "event", f"{tmp_path}/state").awaitTermination()
        except StreamingQueryException:
            pass
    assert len(deaths) == 2 and not u.store.pending()
    want = ev.agg(F.sum("value"), F.count(F.lit(1))).first()
    assert tuple(u.store.read("events").agg(F.sum("value"), F.count(F.lit(1))).first()) == tuple(want)
    for name in ("events_daily", "events_hourly_service"):
        assert u.store.read(name).agg(F.sum("value")).first()[0] == want[0]
    # another checkpoint is another stream, which adds
    u.add_stream(source, "event", f"{tmp_path}/state2").awaitTermination()
    assert u.store.read("events_daily").agg(F.sum("value")).first()[0] == 2 * want[0]


def test_streamed_gauges_keep_latest_values(spark, tmp_path):
    g = spark.range(60).selectExpr("'g' as metric", "id as value", "timestampadd(MINUTE, cast(id * 37 % 60 as int), timestamp_ntz'2026-06-01 00:00:00') as time", "'1' as tenant", "concat('s', id % 3) as service")
    for k in range(3):
        g.where(f"value % 7 % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    u = fresh(spark, tmp_path / "store")
    u.store.declare_latest(("service",))
    u.add_stream(spark.readStream.schema(g.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "gauge", f"{tmp_path}/state").awaitTermination()
    want = {r["service"]: r["value"] for r in g.groupBy("service").agg(F.max_by("value", "time").alias("value")).collect()}
    assert {r["service"]: r["value"] for r in u.find("1", [q.group_by("service")], "gauge")} == want and u.get_route_log()[-1]["route"] == "latest"


# -- pages by month


def test_pages_read_the_months_they_need(spark, tmp_path):
    u = fresh(spark, tmp_path)
    times = [f"20{24 + k // 12}-{1 + k % 12:02d}-{d:02d} 0{d}:00" for k in range(24) for d in (1, 2, 3)]
    u.add_batch([row("m", i, t, tenant=str(1 + i % 2), path=f"/{i % 5}") for i, t in enumerate(times)], "event")
    everything = Meter(Frames(u.store.read("events").drop("month"), u.store.read("gauges")), now=lambda: NOW)
    rng = random.Random(9)
    for k in range(40):
        a, b = sorted(rng.sample(times, 2))
        order = rng.choice([q.order_asc, q.order_desc])
        clauses = [order("time"), q.limit(rng.choice([1, 3, 10, 100])), q.offset(rng.choice([0, 0, 2, 30]))]
        clauses += rng.choice([[], [q.greater_than_equal("time", a), q.less_than("time", b)], [q.equal("path", ["/1", "/2"])]])
        if k % 2:
            at = everything.find("1", [q.equal("time", rng.choice(times[::2]))], "event")[0]
            clauses = [*(c for c in clauses if c.method != "offset"), rng.choice([q.cursor_after, q.cursor_before])({"time": at["time"], "id": at["id"]})]
        assert u.find("1", clauses, "event") == everything.find("1", clauses, "event")
    page = u.find_df("1", [q.order_asc("time"), q.limit(2)], "event")
    assert files_read(page) == 1
    page = u.find_df("1", [q.order_desc("time"), q.cursor_after({"time": "2025-06-02 02:00", "id": "x"}), q.limit(2)], "event")
    assert files_read(page) <= 3
    assert files_read(u.find_df("1", [q.order_asc("path"), q.limit(2)], "event")) == 24


# -- counts from footers


def test_counts_and_maxima_from_footers(spark, tmp_path):
    u = Meter(Store(spark, str(tmp_path)), shared=False, now=lambda: NOW)
    u.setup()
    u.add_batch([{"metric": "m", "value": v, "time": f"2026-0{month}-1{d} 0{d}:00"} for v, (month, d) in enumerate((m, d) for m in range(1, 7) for d in range(5))], "event")
    plain = Meter(Frames(u.store.read("events").drop("month"), u.store.read("gauges")), shared=False, now=lambda: NOW)
    with u.store._pushed_down():
        plan = u.store._summed("events", ["2026-02"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MAX(value)]" in plan
    assert u.store.by_month("events", ["2026-02", "2026-03"]) == {"2026-02": {"n": 5, "most": 9}, "2026-03": {"n": 5, "most": 14}}
    assert spark.conf.get("spark.sql.sources.useV1SourceList").count("parquet") == 1
    for a, b in (("2026-01-01", "2026-07-01"), ("2026-01-11 12:00", "2026-03-14 02:00"), ("2026-02-01", "2026-03-01"), ("2026-02-12", "2026-02-13"), ("2027-01-01", "2028-01-01")):
        window = [q.greater_than_equal("time", a), q.less_than("time", b)]
        for most in (None, 0, 3, 7, 1000):
            assert u.count(None, window, "event", most) == plain.count(None, window, "event", most)
    assert u.count(None, [q.equal("metric", "m")], "event") == u.count(None, kind="event") == 30
    with pytest.raises(ValueError):
        u.count(None, [], "event", -1)
