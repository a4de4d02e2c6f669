"""Queries against their SQL where subscribers are numbered beyond 65,535, as in tables of a gigabyte."""

import duckdb
import pytest

from meterlake.plans import queries

SHIFTS = (0, 65_530, 400_000)


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    found = tmp_path_factory.mktemp("many")
    copies = " union all ".join(f"select event_id + {1000 * i} as event_id, ts, user_id + {shift} as user_id, event_type, value, props from '/root/testdata/sf0.001/events.parquet'" for i, shift in enumerate(SHIFTS))
    duckdb.sql(f"copy ({copies}) to '{found}/events.parquet'")
    return found


@pytest.mark.parametrize("name", ["flows", "flows_document", "meter_events", "top_flows"])
def test_query_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{sf}/events.parquet'")
    df, want = queries.QUERIES[name](spark, str(sf)), duck.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    got = sorted(map(tuple, df.collect()), key=str)
    assert got and got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
