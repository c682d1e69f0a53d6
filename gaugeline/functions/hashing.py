"""Content hashes of ledger samples, in Spark and, with the same result, on the driver."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SAMPLE_IDENTITY, SAMPLE_STREAM

ID_PARTS = (*SAMPLE_IDENTITY, "sequence", "metric")


def digest(parts) -> str:
    """SHA-256 over length-prefixed parts: `<bytes>:<part>` each."""
    text = [str(p) for p in parts]
    return hashlib.sha256("".join(f"{len(p.encode())}:{p}" for p in text).encode()).hexdigest()


def millis(t: datetime) -> str:
    return t.strftime("%Y-%m-%d %H:%M:%S.") + f"{t.microsecond // 1000:03d}"


def digest_column(*parts: Column) -> Column:
    text = [p.cast("string") for p in parts]
    return F.sha2(F.concat(*[x for p in text for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]), 256)


def sample_id() -> Column:
    return digest_column(*[F.col(c) for c in ID_PARTS])


def payload_hash(identity: Column) -> Column:
    def at(c: str) -> Column:
        return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSS")

    return digest_column(identity, at("intervalStart"), at("intervalEnd"), F.col("value"), F.col("eventVersion"))


#: Folders that the ledger's streams are dealt to: a fixed value, as it is part of the stored layout.
BUCKETS = 64


def sample_bucket(stream: list[Column] | None = None) -> Column:
    """The bucket of a row's stream, or of one that is given by values."""
    return F.pmod(F.xxhash64(*(stream or [F.col(c) for c in SAMPLE_STREAM])), F.lit(BUCKETS)).cast("int")
