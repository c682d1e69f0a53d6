"""Where the engine reads: a store, or any DataFrames of the right shape."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from .store import Store, hourly_name, latest_name


@dataclass
class Frames:
    """Tables as DataFrames. Rollups are optional."""

    events: DataFrame
    gauges: DataFrame
    events_daily: DataFrame | None = None
    hourly: dict[str, DataFrame] = field(default_factory=dict)
    latest: dict[tuple[str, ...], DataFrame] = field(default_factory=dict)
    samples: DataFrame | None = None
    uncovered: set[datetime] = field(default_factory=set)
    #: Rows of tables by month, where they are known: of events, gauges, events_daily and the rollups by their stored names.
    rows: dict[str, dict[str, int]] = field(default_factory=dict)
    #: The months that stored events and gauges have rows of.
    months: dict[str, list[str]] = field(default_factory=dict)

    def raw(self, kind: str) -> DataFrame:
        schema.check_type(kind)
        return self.events if kind == schema.EVENT else self.gauges


def of_store(store: Store, counted: bool = False) -> Frames:
    """The store's tables; their files are listed once for each version of the store, not for each read."""
    if store.pending():  # a change is under way or was interrupted: only raw rows are sure to agree with themselves
        return Frames(store.read("events"), store.read("gauges"), samples=store.read("samples"))
    version = store.version()
    if version is None or store.kept is None or store.kept[0] != version:
        store.kept = (version, _listed(store))
    frames = store.kept[1]
    if counted and not frames.rows:
        frames.rows = store.row_counts()
    return frames


def _listed(store: Store) -> Frames:
    return Frames(
        store.read("events"),
        store.read("gauges"),
        store.read("events_daily"),
        {d: store.read(hourly_name(d)) for d in store.hourly_dims()},
        {d: store.read(latest_name(d)) for d in store.latest_dims()},
        store.read("samples"),
        store.uncovered_days(),
        months={n: store.months(n) for n in ("events", "gauges")},
    )


def of_collection(rows: DataFrame) -> Frames:
    """Events and gauges kept as one collection, with their type in the column `type`."""
    events, gauges = (rows.where(F.col("type") == kind).select(*[c for c in schema.table_schema(kind).fieldNames() if c in rows.columns]) for kind in schema.TYPES)
    return Frames(events, gauges)
