import glob
import os

import duckdb
import pytest

from meterlake.plans import queries

SF = "/root/testdata/sf0.001"


def norm(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted((tuple(norm(r[i]) for i in order) for r in found), key=str)
    order = [df.columns.index(c) for c in columns]
    got = rows(df.collect())
    order = [want.columns.index(c) for c in columns]
    assert got == rows(want.fetchall())


def test_the_rest_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 15
    for name in set(queries.QUERIES) - set(queries.ORACLE_SQL):
        assert queries.QUERIES[name](spark, SF).count() > 0
