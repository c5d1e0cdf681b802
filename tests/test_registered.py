"""Every registered query runs on whole tables and equals its check SQL; every name has what it needs."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from wardline.catalog import everything

FOLDER = f"{os.environ.get('TESTDATA', '/root/testdata')}/sf0.001"
STAR = "region nation customer supplier part orders lineitem events".split()
QUERIES, CHECKS = everything.QUERIES, everything.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in STAR:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fixed = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(fixed, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_check_sql():
    assert set(CHECKS) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_check(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = con.execute(CHECKS[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cursor.fetchall(), columns)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "net_payable" in df.columns
