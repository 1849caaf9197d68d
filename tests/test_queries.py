"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def rows(pdf):
    cell = lambda v: None if pd.isna(v) is True else round(float(v), 5) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted(repr(tuple(cell(v) for v in r)) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(want.columns) == names
    assert rows(got.select(*names).toPandas()) == rows(want[names])


def test_entry(spark):
    assert entry.entry(spark).count() == 3
