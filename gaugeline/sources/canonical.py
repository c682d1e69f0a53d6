"""Metering events and ledger samples derived from a plain `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Frames

EV = """cast(event_id as string) as id, event_type as metric, cast(round(value*100) as bigint) as value, ts as time,
 cast(user_id % 10 as string) as tenant, concat('/', event_type, '/p', cast(event_id % 89 as string)) as path,
 concat('verb', cast((event_id + 3*user_id) % 5 as string)) as method,
 cast(200 + 100*(event_id % 3) + user_id % 4 as string) as status,
 concat('svc-', cast(user_id % 7 as string)) as service,
 case when event_id % 17 = 0 then null else concat(chr(cast(97 + (event_id+user_id) % 9 as int)), chr(cast(110 + user_id % 2 as int))) end as country,
 concat('kind', cast(event_id % 4 as string)) as resourceType,
 concat('r', cast(user_id % 31 as string)) as resourceId,
 cast(event_id % 3 as string) as ordinal"""

EV_SQL = "ev AS (select " + EV.replace("as string)", "as varchar)") + " from events)"

GAUGE_COLUMNS = ["id", "metric", "value", "time", "tenant", "service", "resourceType", "resourceId", "ordinal"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_columns(EV))


def _columns(text: str) -> list[str]:
    """The select list, split at the commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    ev = events(spark, sf_dir)
    return Frames(ev, ev.select(*GAUGE_COLUMNS))


#: Four streams of one sample for each event, by the event's id; one in 23 makes a gap of two.
_SEQUENCE = "(event_id - event_id % 4) / 4 + 2 * ((event_id - event_id % 92) / 92)"


def _copy(mark: str, more: int, condition: str = "") -> str:
    return f"""select concat('m', cast(event_id % 4 as {{text}})) as member, cast({_SEQUENCE} as bigint) as sequence, cast(round(value*100) as bigint)+{more} as value, {{start}} as intervalStart, {{end}} as intervalEnd, md5(concat('{mark}-', cast(event_id as {{text}}))) as ingestId from events{condition}"""


#: A sample of every event, and besides it exact copies of some (users 0 in 11) and conflicting ones (1 in 37); some start late (2 in 41).
_SM = " union all ".join((_copy("a", 0), _copy("b", 0, " where user_id % 11 = 0"), _copy("c", 1, " where user_id % 37 = 1")))
_SHIFT = f"({_SEQUENCE})*60+(case when user_id % 41 = 2 then 10 else 0 end)"
SM = _SM.format(start=f"timestampadd(SECOND, cast({_SHIFT} as int), timestamp_ntz'2026-08-01 00:00:00')", end=f"timestampadd(SECOND, cast(({_SEQUENCE}+1)*60 as int), timestamp_ntz'2026-08-01 00:00:00')", text="string")
SM_SQL = "sm AS (" + _SM.format(start=f"timestamp '2026-08-01 00:00:00' + to_seconds(cast({_SHIFT} as bigint))", end=f"timestamp '2026-08-01 00:00:00' + to_seconds(cast(({_SEQUENCE}+1)*60 as bigint))", text="varchar") + ")"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's columns, hashed as the ledger does."""
    from ..functions.hashing import payload_hash, sample_id
    from ..schema import SAMPLES

    raw = spark.sql(SM.replace("from events", "from {ev}"), ev=spark.read.parquet(f"{sf_dir}/events.parquet"))
    named = raw.select("*", *[F.lit(v).alias(c) for c, v in (("environment", "production"), ("region", "fra"), ("projectInternalId", "1"), ("databaseInternalId", "2"), ("generation", "g0"), ("metric", "cpu"))], F.lit(1).cast("bigint").alias("eventVersion"))
    hashed = named.withColumn("id", sample_id()).withColumn("payloadHash", payload_hash(F.col("id")))
    return hashed.select(*SAMPLES.fieldNames())
