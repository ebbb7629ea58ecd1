"""Every registered query against its SQL, on whole tables at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from check import TABLES, compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    ours = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(ours) > 0
    if name in ORACLES:
        assert compare(ours, con.execute(ORACLES[name]).df()) == "ok"


def test_entry(spark):
    assert driver.entry(spark).count() > 0
