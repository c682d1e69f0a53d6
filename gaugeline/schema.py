"""The fixed data model: events (additive), gauges (snapshots), their rollups and the sample ledger."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT, GAUGE = "event", "gauge"
TYPES = (EVENT, GAUGE)

# Dimension columns of events with their largest sizes in bytes, in storage order.
EVENT_DIMS = {
    "path": 1024, "method": 16, "status": 16, "service": 256, "resourceType": 256, "resourceId": 255, "resourceInternalId": 255, "ordinal": 255,
    "teamId": 255, "teamInternalId": 255, "country": 2, "region": 64, "hostname": 255, "ip": 45, "protocol": 16, "accept": 1024,
    "acceptLanguage": 256, "queryKeys": 1024, "ipReputation": 32, "city": 256, "continentCode": 2, "subdivisions": 256, "postalCode": 32, "latitude": 32,
    "longitude": 32, "timeZone": 64, "weatherCode": 16, "isp": 256, "autonomousSystemNumber": 255, "autonomousSystemOrganization": 256,
    "connectionType": 256, "connectionUsageType": 256, "connectionOrganization": 256, "osCode": 256, "osName": 256, "osVersion": 255,
    "clientType": 256, "clientCode": 256, "clientName": 256, "clientVersion": 255, "clientEngine": 256, "clientEngineVersion": 255,
    "sdk": 256, "sdkVersion": 255, "deviceName": 256, "deviceBrand": 256, "deviceModel": 255,
}
# Dimension columns of gauges with their largest sizes.
GAUGE_DIMS = {"service": 256, "resourceType": 256, "teamId": 255, "teamInternalId": 255, "resourceId": 255, "resourceInternalId": 255, "ordinal": 255}
# Dimensions that the daily rollup keeps; replicas (ordinal) are folded.
DAILY_DIMS = ("resourceType", "resourceId", "resourceInternalId", "teamId", "teamInternalId")
# Dimensions of which an hourly rollup of events may be kept, one each.
HOURLY_DIMS = ("resourceType", "path", "country", "service", "method", "status", "clientType", "clientName", "deviceName", "osName", "sdk")
# Dimension sets of which the latest gauge value may be kept.
LATEST_DIMS = (("service",), ("resourceType",), ("resourceId",), ("resourceType", "resourceId"))
# Event dimensions that are read by equality often enough for a Bloom filter on write.
BLOOM_DIMS = ("path", "resourceId", "resourceInternalId", "teamId", "teamInternalId", "hostname", "ip", "region")
# Columns of a sample, the identity first.
SAMPLE_IDENTITY = ("environment", "region", "projectInternalId", "databaseInternalId", "member", "generation")

#: What makes a stream of samples, of which sequences count the rows.
SAMPLE_STREAM = (*SAMPLE_IDENTITY, "metric")

METRIC_SIZE = 255
#: Columns that may be null.
NULLABLE = {"tenant", *EVENT_DIMS, *GAUGE_DIMS}


def _row(dims) -> T.StructType:
    s = T.StringType()
    return T.StructType([
        T.StructField("id", s, False), T.StructField("metric", s, False), T.StructField("value", T.LongType(), False),
        T.StructField("time", T.TimestampNTZType(), False), T.StructField("tenant", s), *[T.StructField(d, s) for d in dims],
    ])


EVENTS = _row(EVENT_DIMS)
GAUGES = _row(GAUGE_DIMS)
EVENTS_DAILY = T.StructType([f for f in EVENTS.fields if f.name in ("metric", "value", "time", "tenant", *DAILY_DIMS)])
SAMPLES = T.StructType([
    *[T.StructField(c, T.StringType(), False) for c in ("id", "payloadHash", "ingestId", *SAMPLE_IDENTITY)],
    T.StructField("sequence", T.LongType(), False), T.StructField("metric", T.StringType(), False),
    T.StructField("intervalStart", T.TimestampNTZType(), False), T.StructField("intervalEnd", T.TimestampNTZType(), False),
    T.StructField("value", T.LongType(), False), T.StructField("eventVersion", T.LongType(), False),
])


def dims(kind: str) -> dict[str, int]:
    check_type(kind)
    return EVENT_DIMS if kind == EVENT else GAUGE_DIMS


def table_schema(kind: str) -> T.StructType:
    check_type(kind)
    return EVENTS if kind == EVENT else GAUGES


def check_type(kind: str) -> None:
    if kind not in TYPES:
        raise ValueError(f"Invalid type '{kind}'. Allowed: {', '.join(TYPES)}")


def attributes(kind: str) -> set[str]:
    """What a query of this type may name."""
    return {"id", "metric", "value", "time", "tenant", *dims(kind)}
