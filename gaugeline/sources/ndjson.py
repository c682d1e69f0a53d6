"""Events and gauges as newline-delimited JSON, under the declared schema, both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import schema


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """metric, value, time, tenant and the dimensions; a line that is no JSON object of these types is an error when read."""
    fields = [f for f in schema.table_schema(kind).fields if f.name != "id"]
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    return spark.read.schema(loose).option("mode", "FAILFAST").json(path)


def write(rows: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """A folder of files with a JSON object on each line, of the declared columns that the rows have; nulls are left out."""
    have = set(rows.columns)
    rows.select(*[c for c in schema.table_schema(kind).fieldNames() if c in have]).write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
