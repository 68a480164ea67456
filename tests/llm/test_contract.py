"""Every operator's SQL against its query on the smallest tables."""

import math

import duckdb
import pytest

from beaconry.llm import registry

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(values):
    norm = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(map(norm, r)) for r in values), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    found = db.sql(registry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(df.columns)
    at = [found.columns.index(c) for c in columns]
    assert rows([r[c] for c in columns] for r in df.collect()) == rows([r[i] for i in at] for r in found.fetchall())
