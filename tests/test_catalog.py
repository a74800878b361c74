"""Every query against its SQL statement, on the smallest data set."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as driver
from molweave.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(driver.oracle_sql())
    assert set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    found = driver.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in found.collect()), key=str)
    asked = duck.execute(driver.oracle_sql()[name])
    names = [c[0] for c in asked.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in asked.fetchall()), key=str)
    assert got == want
