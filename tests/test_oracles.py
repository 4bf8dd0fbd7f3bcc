"""Every query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import factgraph.plans  # noqa: F401
from factgraph.plans.registry import ORACLES, QUERIES
from factgraph.sources.binding import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(int(v) if hasattr(v, "as_integer_ratio") and not isinstance(v, bool) and v == int(v) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({ORACLES[name]}) q")
    assert plain(df.select(cols).collect()) == plain(want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
