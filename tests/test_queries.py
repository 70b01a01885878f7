"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from glossa.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(df):
    def plain(v):
        v = v.item() if hasattr(v, "item") and not hasattr(v, "__len__") else v
        v = v.tolist() if hasattr(v, "tolist") else v
        return None if v is None or v != v else round(v, 5) + 0.0 if isinstance(v, float) else v

    cols = sorted(df.columns)
    found = df[cols].astype(object).where(df[cols].notna(), None).values.tolist()
    return cols, sorted(str([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in map(plain, r)]) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert rows(catalogue.queries()[name](spark, SF).toPandas()) == rows(duck.execute(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
