"""Every registered query against its DuckDB text."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {name} as select * from '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, float, Decimal)):
        return round(float(value), 6)
    return str(value)


def table(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, sf_dir, name):
    result = entry.queries()[name](spark, sf_dir)
    columns = sorted(result.columns)
    mine = table(result.select(*columns).collect())
    assert mine
    sql = entry.oracle_sql().get(name)
    if sql:
        other = duck.sql(sql)
        assert sorted(other.columns) == columns
        order = [other.columns.index(c) for c in columns]
        assert mine == table([tuple(r[i] for i in order) for r in other.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
