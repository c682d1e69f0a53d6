"""Rows as an API gives them out: `$id`, and times as ISO text in UTC."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from typing import Any


def iso(t: datetime) -> str:
    """Seconds, or milliseconds where there are any."""
    return t.isoformat(timespec="milliseconds" if t.microsecond else "seconds") + "+00:00"


def api_row(row: Mapping[str, Any], interval: str | None = None) -> dict[str, Any]:
    """Buckets of weeks and months are dates."""
    out = {("$id" if k == "id" else k): v for k, v in row.items()}
    if isinstance(out.get("time"), datetime):
        out["time"] = out["time"].date().isoformat() + "+00:00" if interval in ("1w", "1M") else iso(out["time"])
    return out
