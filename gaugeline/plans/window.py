"""Half-open time windows, and how rollups cover them. No Spark here."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta

from .query import COMPARISONS, Query, utc

TICK = timedelta(microseconds=1)
HOUR, DAY = timedelta(hours=1), timedelta(days=1)


@dataclass(frozen=True)
class Window:
    """lo <= time < hi; None is unbounded."""

    lo: datetime | None = None
    hi: datetime | None = None

    @property
    def empty(self) -> bool:
        return self.lo is not None and self.hi is not None and self.lo >= self.hi


def floor(t: datetime, step: timedelta) -> datetime:
    at = datetime(1970, 1, 1)
    return at + (t - at) // step * step


def ceil(t: datetime, step: timedelta) -> datetime:
    f = floor(t, step)
    return f if f == t else f + step


def reduce_window(filters: Iterable[Query]) -> tuple[Window, list[Query]] | None:
    """The window of all predicates on time and the other filters; None if one of them isn't a bound."""
    lo: datetime | None = None
    hi: datetime | None = None
    rest: list[Query] = []
    for q in filters:
        if q.attribute != "time":
            rest.append(q)
            continue
        if q.method not in COMPARISONS and q.method != "between":
            return None
        v = [utc(x) for x in q.values]
        starts = {"greaterThan": v[0] + TICK, "greaterThanEqual": v[0], "between": v[0]}
        ends = {"lessThan": v[0], "lessThanEqual": v[0] + TICK, "between": v[-1] + TICK}
        if q.method in starts:
            lo = starts[q.method] if lo is None else max(lo, starts[q.method])
        if q.method in ends:
            hi = ends[q.method] if hi is None else min(hi, ends[q.method])
    return Window(lo, hi), rest


@dataclass(frozen=True)
class Cover:
    """An interior that a rollup answers, and the raw pieces around it."""

    interior: Window
    edges: tuple[Window, ...]


def cover(w: Window, step: timedelta, cap: datetime | None = None) -> Cover | None:
    """Whole steps inside w, before cap, and what is left on either side; None without a whole step."""
    if w.empty:
        return None
    lo = None if w.lo is None else ceil(w.lo, step)
    hi = None if w.hi is None else floor(w.hi, step)
    if cap is not None:
        hi = floor(cap, step) if hi is None else min(hi, floor(cap, step))
    if lo is not None and hi is not None and lo >= hi:
        return None
    edges = []
    if w.lo is not None and w.lo < lo:
        edges.append(Window(w.lo, lo))
    if hi is not None and (w.hi is None or hi < w.hi):
        edges.append(Window(hi, w.hi))
    return Cover(Window(lo, hi), tuple(edges))


def whole_months(w: Window, months: Iterable[str]) -> tuple[list[str], list[Window]]:
    """Those of the months that lie in w, and what of w is in the others."""
    inside, edges = [], []
    for m in sorted(months):
        lo = datetime.fromisoformat(f"{m}-01")
        hi = (lo + timedelta(days=32)).replace(day=1)
        cut = Window(max(lo, w.lo or lo), min(hi, w.hi or hi))
        if cut == Window(lo, hi):
            inside.append(m)
        elif not cut.empty:
            edges.append(cut)
    return inside, edges


def label(w: Window, c: Cover | None, now: datetime) -> str:
    """daily, hybrid (days before today, then raw), split (raw edges) or raw."""
    if c is None:
        return "raw"
    if not c.edges:
        return "daily"
    today = floor(now, DAY)
    only_tail = len(c.edges) == 1 and c.edges[0].lo == c.interior.hi
    return "hybrid" if only_tail and c.interior.hi == today else "split"
