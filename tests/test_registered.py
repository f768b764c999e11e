"""Every registered query against its SQL on the small tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = normal([tuple(r) for r in df.select(*columns).collect()])
    assert got
    if name in oracle_sql():
        cursor = con.execute(oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert [names[i] for i in order] == columns
        assert got == normal([tuple(r[i] for i in order) for r in cursor.fetchall()])


def test_entry_runs(spark):
    assert entry(spark).count() == 20


def test_sql_has_a_query_for_every_key():
    assert set(oracle_sql()) <= set(queries())
