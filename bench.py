"""Headline metering queries on the driver's events: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all) choose the data and the
cores, BENCH_TIMES how often each event is taken (default 1; 10 makes a million events of sf0.1). A store with its
rollups is built first (as `setup`, not part of the value); then each query runs once to warm up and five times for
its median, through a Meter of the store that chooses routes by rows to be read. `value` is the sum of the medians;
`routes` has the route of each query and, where it was chosen by them, the rows to be read.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time
from datetime import datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gaugeline import schema  # noqa: E402
from gaugeline.engine import Meter  # noqa: E402
from gaugeline.plans import query as q  # noqa: E402
from gaugeline.sources import canonical, synthetic  # noqa: E402
from gaugeline.sources.store import Store  # noqa: E402

ROUNDS = 5


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    at = tempfile.mkdtemp(prefix="gaugeline-bench-")  # local mode: driver and executors are one process
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .config("spark.checkpoint.dir", f"{at}/checkpoint")
        .getOrCreate()
    )
    try:
        print(json.dumps(run(spark, sf_dir, at, int(os.environ.get("BENCH_TIMES", "1")))))
    finally:
        spark.stop()
        shutil.rmtree(at, ignore_errors=True)


def filled(spark, sf_dir: str, at: str, times: int) -> tuple[Meter, float]:
    start = time.perf_counter()
    u = Meter(Store(spark, at), now=lambda: datetime(2024, 1, 30, 12), by_cost=True)
    u.setup()
    t = canonical.frames(spark, sf_dir)
    events = t.events if times == 1 else synthetic.multiplied(t.events, times, 0)
    for kind, df in ((schema.EVENT, events), (schema.GAUGE, t.gauges)):
        names = schema.table_schema(kind).fieldNames()
        u.store.append(df.withColumns({c: F.lit(None).cast("string") for c in names if c not in df.columns}), kind)
    for d in ("path", "country", "service"):
        u.store.declare_hourly(d)
    for d in (("service",), ("resourceType",)):
        u.store.declare_latest(d)
    return u, time.perf_counter() - start


def run(spark, sf_dir: str, at: str, times: int) -> dict:
    reader, setup = filled(spark, sf_dir, f"{at}/store", times)
    tables = reader.tables()
    month = [q.greater_than_equal("time", "2024-01-01"), q.less_than("time", "2024-01-31")]
    odd = [q.greater_than_equal("time", "2024-01-01 00:20:30"), q.less_than("time", "2024-01-30 11:40:10")]
    today = [q.greater_than_equal("time", "2024-01-30"), q.less_than("time", "2024-01-30 11:40:10")]
    batch = [{"tenant": "1", "metric": "click", "value": i, "time": f"2024-01-{1 + i % 28:02d} 10:00:00", "tags": {"path": f"/v1/{i % 100}", "service": "storage"}} for i in range(10_000)]
    fresh = Meter(Store(spark, f"{at}/insert"))
    fresh.setup()
    rolled = Meter(Store(spark, f"{at}/insert_rolled"))
    rolled.setup()
    rolled.store.declare_hourly("path")

    def top(dims, window, *more, kind="event"):
        return lambda: reader.find("3", [*[q.group_by(d) for d in dims], *window, *more, q.limit(10)], kind)

    def raw(dims, window):
        plain = Meter(type(tables)(tables.events, tables.gauges), now=reader._now)
        return lambda: plain.find("3", [*[q.group_by(d) for d in dims], *window, q.limit(10)], "event")

    queries = {
        "events_sum_30d": lambda: reader.sum("3", month),
        "events_sum_30d_split": lambda: reader.sum("3", odd),
        "events_timeseries_30d_1h": lambda: reader.get_time_series("3", ["click"], "1h", "2024-01-01", "2024-01-31", kind="event"),
        "events_count_max_5k": lambda: reader.count("3", month, "event", 5000),
        "insert_10k": lambda: fresh.add_batch(batch, "event"),
        "insert_10k_with_hourly": lambda: rolled.add_batch(batch, "event"),
        "events_topN_path_30d": top(["path"], month),
        "events_topN_country_30d": top(["country"], month),
        "events_topN_service_30d": top(["service"], month),
        "events_topN_path_30d_split": top(["path"], odd),
        "events_topN_path_30d_raw": raw(["path"], odd),
        "events_topN_path_today_partial": top(["path"], today),
        "events_topN_path_30d_filtered_resource": top(["path"], month, q.equal("resourceId", "r3")),
        "events_topN_path_country": top(["path", "country"], month),
        "gauges_latest_in_window": lambda: reader.get_total("3", "click", month, "gauge"),
        "gauges_topN_service_30d": top(["service"], month, kind="gauge"),
        "gauges_topN_service_latest": top(["service"], [], kind="gauge"),
        "gauges_topN_resourceType_30d": top(["resourceType"], month, kind="gauge"),
        "gauges_topN_service_today_partial": top(["service"], today, kind="gauge"),
    }
    seconds, routes = {}, {}
    for name, f in queries.items():
        reader.clear_route_log()
        f()
        routes |= {name: f"{x['route']} {x['rows']}" if "rows" in x else x["route"] for x in reader.get_route_log()}
        took = []
        for _ in range(ROUNDS):
            start = time.perf_counter()
            f()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 4)
    return {"metric": "metering_headline_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "events": sum(tables.rows.get("events", {}).values()), "routes": routes, "setup_sec": round(setup, 2)}


if __name__ == "__main__":
    main()
