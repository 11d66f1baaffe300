"""Every registered query against its SQL twin, over whole tables."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from hirelake.plans.checks import CHECKS
from hirelake.plans.registry import QUERIES
from hirelake.sources.views import BASE_TABLES

SF_DIR = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def _normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_normal(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = _sorted(df.collect(), df.columns)
    cursor = duck.execute(CHECKS[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = _sorted(cursor.fetchall(), list(kinds))
    assert sorted(df.columns) == sorted(kinds)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == kinds
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(driver.queries()) and set(CHECKS) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).count() == 1500
