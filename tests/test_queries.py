"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from textloom.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="supplied tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF_DIR}/{file}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(entry_module.oracle_sql()[name])
    assert got == rows([d[0] for d in result.description], result.fetchall())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["split", "samples"] and df.count() == 3
