"""Registered queries against DuckDB on the smallest given tables."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tracemill.plans.expected_sql import STATEMENTS

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()
# Their columns depend on the data; the statements list all that can occur.
OBSERVED = {"legacy_wide", "legacy_wide_testing"}
CHECKED = sorted(set(STATEMENTS) - OBSERVED)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else round(float(value), 9)
    return value


@pytest.fixture(scope="module", autouse=True)
def compiled_plans(spark):
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    frame = entry_module.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    result = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(OBSERVED))
def test_observed_columns_equal_sql(spark, duck, name):
    """Columns that no row fills are left out by the query and zero in the statement."""
    frame = entry_module.queries()[name](spark, FOLDER)
    result = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert set(frame.columns) <= set(names)
    want = sorted(tuple(plain(v) or 0 for v in r) for r in result.fetchall())
    got = sorted(tuple((r[n] or 0) if n in frame.columns else 0 for n in names) for r in frame.collect())
    assert [tuple(map(int, r)) for r in got] == [tuple(map(int, r)) for r in want]


@pytest.mark.parametrize("name", ["filename_display", "file_inventory", "svm_scores", "forest_scores"])
def test_query_without_sql_gives_rows(spark, name):
    assert entry_module.queries()[name](spark, FOLDER).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_returns_windows(spark):
    assert entry_module.entry(spark).count() > 0
