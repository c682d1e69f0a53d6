from datetime import UTC, datetime, timedelta, timezone

import pytest

from gaugeline.plans import query as q
from gaugeline.plans import router
from gaugeline.plans import window as w

NOW = datetime(2026, 6, 20, 12)


def at(text):
    return datetime.fromisoformat(text)


def test_factories_reject():
    with pytest.raises(ValueError):
        q.group_by_interval("2h")
    with pytest.raises(ValueError):
        q.aggregate("avg")
    with pytest.raises(ValueError):
        q.group_by("")
    for clause in (q.equal("path", []), q.contains("path", []), q.not_contains("path", [])):
        with pytest.raises(ValueError, match="needs a value"):
            q.parse([clause])
    with pytest.raises(ValueError):
        q.parse([q.Query("median", "value", (1,))])
    for n in ("5", 1.5, True, -1):
        with pytest.raises(ValueError):
            q.parse([q.limit(n)])
    with pytest.raises(TypeError):
        q.parse(["metric = 1"])


def test_attributes_are_checked_by_type():
    spec = q.parse([q.equal("path", "/x")])
    assert q.applies(spec, "event") and not q.applies(spec, "gauge")
    with pytest.raises(ValueError, match="path"):
        q.check(spec, "gauge")
    for bad in ([q.equal("nothing", "x")], [q.order_asc("nothing")], [q.group_by("metric")]):
        with pytest.raises(ValueError):
            q.check(q.parse(bad), "event")
    with pytest.raises(ValueError, match="interval"):
        q.check(q.parse([q.group_by("service"), q.order_asc("time")]), "event")


def test_cursor_rules():
    row = {"$id": "7", "time": "2026-01-01"}
    assert q.parse([q.cursor_after(None), q.cursor_before(row)]).cursor == {"id": "7", "time": "2026-01-01"}
    assert q.parse([q.cursor_after(row), q.cursor_before({"id": "8"})]).before is False
    for grouped in (q.group_by_interval("1h"), q.group_by("path"), q.aggregate("max")):
        with pytest.raises(ValueError):
            q.parse([q.cursor_after(row), grouped])
    with pytest.raises(TypeError):
        q.parse([q.cursor_after("7")])


def test_time_literals_become_utc():
    assert q.utc("2026-06-01T02:00:00+02:00") == datetime(2026, 6, 1)
    assert q.utc(datetime(2026, 6, 1, 2, tzinfo=timezone(timedelta(hours=2)))) == datetime(2026, 6, 1)
    assert q.utc(datetime(2026, 6, 1, tzinfo=UTC)).tzinfo is None
    with pytest.raises(ValueError):
        q.utc("yesterday-ish")


def test_windows_reduce_to_half_open():
    got, rest = w.reduce_window([q.greater_than("time", "2026-06-01"), q.less_than_equal("time", "2026-06-03"), q.equal("metric", "m"), q.between("time", "2026-05-01", "2026-06-02")])
    assert got == w.Window(at("2026-06-01 00:00:00.000001"), at("2026-06-02 00:00:00.000001")) and [x.attribute for x in rest] == ["metric"]
    assert w.reduce_window([q.not_equal("time", "2026-06-01")]) is None
    assert w.reduce_window([]) == (w.Window(), [])


def test_cover():
    c = w.cover(w.Window(at("2026-06-01 10:30"), at("2026-06-05 01:00")), w.DAY)
    assert c.interior == w.Window(at("2026-06-02"), at("2026-06-05")) and c.edges == (w.Window(at("2026-06-01 10:30"), at("2026-06-02")), w.Window(at("2026-06-05"), at("2026-06-05 01:00")))
    assert w.cover(w.Window(at("2026-06-01 10:30"), at("2026-06-02 09:00")), w.DAY) is None
    assert w.cover(w.Window(at("2026-06-05"), at("2026-06-01")), w.DAY) is None
    assert w.cover(w.Window(), w.DAY, NOW).interior == w.Window(None, at("2026-06-20"))
    assert w.floor(at("1969-12-31 23:10"), w.HOUR) == at("1969-12-31 23:00")


@pytest.mark.parametrize(
    ("clauses", "route"),
    [
        ([q.greater_than_equal("time", "2026-06-01"), q.less_than("time", "2026-06-05")], "daily"),
        ([q.less_than("time", "2026-06-05")], "daily"),
        ([q.greater_than_equal("time", "2026-06-01"), q.less_than("time", "2026-06-20 11:00")], "hybrid"),
        ([q.greater_than_equal("time", "2026-06-01"), q.less_than_equal("time", "2027-01-01")], "hybrid"),
        ([q.greater_than_equal("time", "2026-06-01"), q.less_than_equal("time", "2026-06-05")], "split"),
        ([q.greater_than("time", "2026-06-01"), q.less_than("time", "2026-06-05")], "split"),
        ([q.between("time", "2026-06-01 09:00", "2026-06-05 10:00")], "split"),
        ([q.between("time", "2026-06-01 09:00", "2026-06-02 10:00")], "raw"),
        ([q.greater_than_equal("time", "2026-06-20 01:00"), q.less_than("time", "2026-06-25")], "raw"),
        ([q.greater_than_equal("time", "2026-06-01")], "raw"),
        ([q.is_not_null("time"), q.less_than("time", "2026-06-05")], "raw"),
        ([q.equal("path", "/x"), q.less_than("time", "2026-06-05")], "raw"),
        ([q.equal("value", 1), q.less_than("time", "2026-06-05")], "raw"),
        ([q.equal("id", "1"), q.less_than("time", "2026-06-05")], "raw"),
        ([q.group_by("service"), q.less_than("time", "2026-06-05")], "raw"),
        ([q.group_by_interval("1d"), q.less_than("time", "2026-06-05")], "raw"),
        ([q.equal("resourceId", "r"), q.equal("metric", "m"), q.less_than("time", "2026-06-05")], "daily"),
    ],
)
def test_sum_routes(clauses, route):
    assert router.sum_route(q.parse(clauses), NOW).label == route


def test_days_without_rollup_go_raw():
    spec = q.parse([q.greater_than_equal("time", "2026-06-01"), q.less_than("time", "2026-06-05")])
    assert router.sum_route(spec, NOW, {at("2026-06-03")}).label == "raw"
    assert router.sum_route(spec, NOW, {at("2026-06-05")}).label == "daily"


def test_hourly_routes():
    window = [q.greater_than_equal("time", "2026-06-01 01:00"), q.less_than("time", "2026-06-05 04:00")]
    odd = [q.greater_than_equal("time", "2026-06-01 01:20"), q.less_than("time", "2026-06-05 04:00")]

    def label(clauses, kind="event", dims=("service", "path")):
        return router.hourly_route(q.parse(clauses), kind, dims).label

    assert label([q.group_by("service"), *window]) == "hourly"
    assert label([q.group_by("service"), q.group_by_interval("1w"), *odd]) == "split"
    assert label([q.group_by_interval("1h"), *odd]) == "split"
    assert label([q.group_by("service"), *odd], "gauge") == "raw"
    assert label([q.group_by("service"), q.aggregate("max"), *odd]) == "raw"
    assert label([q.group_by("service"), q.group_by_interval("15m"), *odd]) == "raw"
    assert label([q.group_by("service"), q.equal("path", "/x"), *odd]) == "raw"
    assert label([q.group_by("service"), q.equal("service", "x"), *odd]) == "split"
    assert label([q.group_by("country"), *odd]) == "raw"
    assert label([q.group_by("service"), q.group_by("path"), *odd]) == "raw"
    assert label([q.group_by("service"), q.between("time", "2026-06-01 01:10", "2026-06-01 01:50")]) == "raw"
    assert label([q.group_by("service"), *odd], dims=()) == "raw"
