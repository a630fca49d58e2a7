"""Every registered query against its SQL, on the smallest tables; the operators' own edge cases are in other files."""

import os

import duckdb
import pytest

from netlattice.plans import catalog as queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, duck, name):
    got = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    expected = duck.sql(f"SELECT {names} FROM ({queries.ORACLES[name]}) q").fetchall()
    rows = [tuple(map(str, r)) for r in got.select(*columns).collect()]
    assert sorted(rows) == sorted(tuple(map(str, r)) for r in expected)


def test_every_query_has_sql():
    assert set(queries.ORACLES) == set(queries.QUERIES)
