"""The driver's contract: every query with SQL agrees with DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith(("op", "pipeline"))}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(values):
    norm = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(map(norm, r)) for r in values), key=lambda r: [(x is not None, str(x)) for x in r])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SQL)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    found = db.sql(SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(df.columns)
    at = [found.columns.index(c) for c in columns]
    assert rows([r[c] for c in columns] for r in df.collect()) == rows([r[i] for i in at] for r in found.fetchall())
