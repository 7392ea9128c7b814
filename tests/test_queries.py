"""Every query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from tidemark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf_dir, name):
    got = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    found = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert rows == sorted(found, key=repr) and rows


def test_entry_and_keys(spark):
    assert driver.entry(spark).columns == ["seq", "response"]
    assert set(driver.oracle_sql()) <= set(driver.queries())
