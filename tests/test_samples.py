import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeline.engine import Meter
from gaugeline.functions.hashing import payload_hash, sample_id
from gaugeline.operators import samples as s
from gaugeline.sources.store import Store

T0 = datetime(2026, 8, 1)


def sample(n, value=10, **k):
    a = T0 + timedelta(minutes=n)
    return replace(s.Sample("production", "fra", "1", "2", "m0", "g0", n, "cpu", a, a + timedelta(minutes=1), value, 1), **k)


def span(first, last):
    return s.SampleRange("production", "fra", "1", "2", "m0", "g0", "cpu", first, last, T0 + timedelta(minutes=first), T0 + timedelta(minutes=last + 1))


@pytest.fixture
def meter(spark, tmp_path):
    u = Meter(Store(spark, str(tmp_path)))
    u.setup()
    return u


def read(u, r, limit=100):
    return u.find_samples(r, u.get_sample_watermark(r, limit), limit)


def test_hashes_agree(spark):
    x = sample(7, 42, member="mé")
    df = s.to_frame(spark, [x]).withColumn("i", sample_id()).withColumn("p", payload_hash(F.col("i")))
    r = df.first()
    assert (r["i"], r["p"]) == (x.id, x.payload_hash) == (r["id"], r["payloadHash"])
    assert x.id != replace(x, sequence=8).id and x.payload_hash != replace(x, value=43).payload_hash and x.id == replace(x, value=43).id


def test_validation():
    for bad in ({"member": ""}, {"sequence": -1}, {"eventVersion": 0}, {"eventVersion": 1 << 32}, {"intervalEnd": T0}):
        with pytest.raises(ValueError):
            sample(0, **bad)
    with pytest.raises(ValueError):
        span(3, 2)
    with pytest.raises(ValueError):
        s.SampleGap(3, 2)
    with pytest.raises(ValueError):
        s.SampleWatermark(span(0, 1), ("x",), False)


def test_duplicates(meter):
    meter.add_samples([sample(0)] * 3)
    got = read(meter, span(0, 0))
    assert got.samples == (sample(0),) and got.duplicate_count == 2 and got.complete


def test_conflict(meter):
    meter.add_samples([sample(0, 10), sample(0, 11)])
    got = read(meter, span(0, 0))
    assert got.conflicts == (0,) and got.samples == () and not got.complete and got.duplicate_count == 0


def test_gap_and_outside(meter):
    meter.add_samples([sample(0), sample(4), sample(6)])
    assert read(meter, span(0, 4)).gaps == (s.SampleGap(1, 3),)
    got = read(meter, replace(span(0, 4), intervalStart=T0 + timedelta(seconds=1)))
    assert got.conflicts == (0,) and got.gaps == (s.SampleGap(0, 3),)
    assert read(meter, span(7, 9)).gaps == (s.SampleGap(7, 9),)


def test_discontinuity(meter):
    meter.add_samples([sample(0), sample(1, intervalStart=T0 + timedelta(minutes=1, seconds=30)), sample(2)])
    got = read(meter, span(0, 2))
    assert got.discontinuities == (1,) and got.gaps == () and not got.complete
    assert read(meter, span(0, 3)).discontinuities == (1, 2)


def test_truncation_and_watermark(meter):
    meter.add_samples([sample(0), sample(1), sample(2)])
    r = span(0, 3)
    cut = meter.get_sample_watermark(r, 2)
    assert cut.truncated and len(cut.entries) == 2
    mark = meter.get_sample_watermark(r, 10)
    meter.add_samples([sample(3)])
    got = meter.find_samples(r, mark, 10)
    assert got.gaps == (s.SampleGap(3, 3),) and len(got.samples) == 3
    assert meter.find_samples(r, mark, 2).truncated
    assert read(meter, r).complete
    with pytest.raises(ValueError):
        meter.find_samples(span(0, 2), mark, 10)
    for n in (0, s.MOST):
        with pytest.raises(ValueError):
            meter.get_sample_watermark(r, n)


@pytest.mark.parametrize("bits", [0, 2, s.BITS])
def test_long_streams_equal_brute_force(spark, bits):
    rng = random.Random(bits)
    streams = {m: [sample(n, member=m or "x", intervalStart=T0 + timedelta(minutes=n, seconds=rng.choice([0, 0, 0, 9]))) for n in sorted(rng.sample(range(40), k))] for m, k in (("a", 25), ("b", 3), ("c", 1), ("d", 40), (None, 12))}
    frame = s.to_frame(spark, [x for xs in streams.values() for x in xs]).withColumn("member", F.expr("nullif(member, 'x')"))
    end, gaps, jumps = T0 + timedelta(minutes=40), [], []
    for xs in streams.values():
        held = [-1, *[x.sequence for x in xs], 40]
        gaps += [(a + 1, b - 1) for a, b in zip(held, held[1:]) if b > a + 1]
        ended = [T0, *[x.intervalEnd for x in xs]]
        jumps += [x.sequence for x, e in zip(xs, ended) if x.intervalStart != e or (x is xs[-1] and x.intervalEnd != end)]
    more = {} if bits == s.BITS else {"bits": bits}
    assert sorted(map(tuple, s.gaps(frame, 0, 39, **more).collect())) == sorted(gaps)
    assert sorted(r["sequence"] for r in s.discontinuities(frame, T0, end, **more).collect()) == sorted(jumps)
    assert [tuple(r) for r in s.gaps(frame.limit(0), 3, 5, **more).collect()] == [(3, 5)]


def test_no_task_takes_a_whole_stream(spark):
    n = 3 << s.BITS
    one = spark.range(n).select(*[F.lit("x").alias(c) for c in s.STREAM], F.col("id").alias("sequence"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("intervalStart"), F.timestamp_seconds(F.col("id") + 1).cast("timestamp_ntz").alias("intervalEnd"))
    assert s.gaps(one.where(f"sequence not in (7, {1 << s.BITS})"), 0, n - 1).count() == 2
    plan = s.discontinuities(one, datetime(1970, 1, 1), datetime(1970, 1, 1) + timedelta(seconds=n))._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert windows and all("block_" in x for x in windows)


# -- layout and stored watermarks


def files_read(df):
    """Files that the frame's scans read, by their metrics."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numFiles").value())
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    walk(plan)
    return sum(found)


def test_one_stream_reads_its_bucket(spark, meter):
    rows = [sample(n, member=f"m{k}") for k in range(60) for n in range(5)]
    meter.store.append_samples(s.to_frame(spark, rows))
    assert len(meter.store._files_in("samples")) >= 30
    r = replace(span(0, 4), member="m17")
    assert files_read(s.in_range(meter.tables().samples, r)) <= 2
    assert [x.sequence for x in read(meter, r).samples] == [0, 1, 2, 3, 4]


def test_ledger_files_are_sorted(spark, meter):
    meter.store.append_samples(s.to_frame(spark, [sample(n, member=f"m{n % 7}") for n in range(400, 0, -1)]))
    for f in meter.store._files_in("samples"):
        rows = spark.read.parquet(meter.store._at(f"samples/{f}")).select("member", "sequence").collect()
        assert rows == sorted(rows)


@pytest.mark.parametrize("limit", [1, 2, 3, 7, 8, 9, 30, 1000])
def test_stored_watermark_equals_small_one(spark, meter, limit):
    rng = random.Random(limit)
    meter.add_samples([sample(n) for n in (0, 3, 3, 3, 3, 5, 5, 6, 9, 300, 70_000, 70_001) for _ in range(rng.randrange(1, 3))])
    r = span(0, 80_000)
    small, stored = meter.get_sample_watermark(r, limit), meter.store_sample_watermark(r, limit)
    assert (stored.count, stored.truncated) == (len(small.entries), small.truncated)
    entries = [":".join(x[1:]) for x in meter.store.members(stored).select("sequence", *s.ENTRY_PARTS).collect()]
    assert sorted(entries) == sorted(small.entries)
    assert meter.store.watermark(stored.name) == stored
    meter.add_samples([sample(4)])
    want = meter.find_samples(r, small, 10_000)
    got = meter.find_sample_frames(r, stored)
    assert [x["sequence"] for x in got.conflicts.orderBy("sequence").collect()] == list(want.conflicts)
    assert [tuple(x) for x in got.gaps.orderBy("gap_first").collect()] == [(g.first, g.last) for g in want.gaps]
    assert tuple(got.summary().first()) == (len(want.samples), len(want.conflicts), len(want.gaps), len(want.discontinuities), want.duplicate_count)
    with pytest.raises(ValueError):
        meter.find_sample_frames(span(0, 1), stored)
    meter.store.drop_watermark(stored.name)
    with pytest.raises(ValueError):
        meter.store.watermark(stored.name)


def test_tampered_watermark_is_refused(spark, meter):
    meter.add_samples([sample(n) for n in range(5)])
    mark = meter.store_sample_watermark(span(0, 4), 10)
    meter.store.members(mark).limit(1).write.mode("append").parquet(meter.store._at(f"_watermarks/{mark.name}"))
    with pytest.raises(ValueError):
        meter.find_sample_frames(span(0, 4), mark)


def test_members_are_broadcast_only_when_small(spark, meter):
    meter.add_samples([sample(n) for n in range(5)])
    r = span(0, 4)
    entries = s.members(meter.tables().samples, r)
    for count, broadcast in ((5, True), (10_000_000, False)):
        plan = s.seen(meter.tables().samples, r, entries, count)._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == broadcast
