import duckdb
import pytest

from gaugeline import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{DATA}/events.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.queries()))
def test_equals_sql(spark, con, name):
    got = queries.queries()[name](spark, DATA).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(d):
        return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))

    assert rows(got) == rows(want)
