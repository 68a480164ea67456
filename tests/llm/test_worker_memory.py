"""What crosses between the JVM and its workers at once, and what a worker keeps after a batch."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beaconry.llm import common, minhash, mixing, packing
from beaconry.llm.common import TEXT_ROWS, Stash

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_batches_while_a_table_is_written(spark):
    def _sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    stash, before = Stash(spark), spark.conf.get(BATCH)
    rows = spark.range(0, 2_500, 1, 1).mapInArrow(_sizes, "n long")
    largest = lambda rows_, limit: stash.put(rows_, limit).agg(F.max("n"), F.sum("n")).first()
    assert tuple(largest(rows, 1_000)) == (1_000, 2_500) and tuple(largest(rows, None)) == (2_500, 2_500)
    assert spark.conf.get(BATCH) == before
    with pytest.raises(Exception):
        stash.put(rows.select(F.raise_error(F.lit("no")).cast("string").alias("n")), 1_000)
    assert spark.conf.get(BATCH) == before
    spark.conf.set(BATCH, 300)  # a smaller setting holds
    try:
        assert tuple(largest(rows, 1_000)) == (300, 2_500)
    finally:
        spark.conf.set(BATCH, before)
    stash.drop()


def test_texts_travel_in_small_batches(spark, monkeypatch):
    """Every table that workers make from texts is written in batches of TEXT_ROWS, and rates need no texts."""
    seen, put = [], Stash.put

    def spy(self, df, rows=None):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        seen.append((rows, "MapInArrow" in plan and "text" in plan))
        return put(self, df, rows)

    monkeypatch.setattr(Stash, "put", spy)
    docs = spark.createDataFrame([(i, f"one two three four five {i % 3}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    mixed, m = mixing.mix(docs, labels)
    makers = [mixed, packing.pack_documents(docs), minhash.near_duplicates(docs)]
    assert [t.count() for t in makers] == [30, 30, 30]
    assert len([rows for rows, texts in seen if texts]) >= 3 and all(rows == TEXT_ROWS for rows, texts in seen if texts)
    plan = mixed.filter(f"{m}.copies > 0")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1


def test_the_text_is_read_from_the_row(spark):
    """As a string it travels once; as another type it still counts, and passes through unchanged."""
    docs = spark.createDataFrame([(i, f"alpha beta {i % 7}", i) for i in range(1_500)], "`an id` long, `te.xt` string, z int")
    labels = spark.createDataFrame([(i, i % 2, i // 2 % 2) for i in range(400)], "`an id` long, quality int, toxic int")
    found = []
    for kind in ("string", "binary"):
        given = docs.withColumn("te.xt", F.col("`te.xt`").cast(kind))
        mixed, m = mixing.mix(given, labels, text_col="te.xt", id_col="an id")
        assert mixed.schema.fields[:3] == given.schema.fields
        found.append(mixed.orderBy("z").select("z", F.col("`te.xt`").cast("string"), f"{m}.*").collect())
    assert found[0] == found[1] and [r["z"] for r in found[0]] == list(range(1_500)) and {r["n_tokens"] for r in found[0]} == {4}


def test_rates_of_a_column(spark):
    g = np.random.default_rng(2)
    p, steps = g.dirichlet([0.3, 0.3, 0.3], 500), [(0.0 if i < 2 else i / (i + 3), g.normal(0, 0.1, 3)) for i in range(20)]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(p.tolist())], "i long, p array<double>")
    for taken in (steps, []):
        got = [r["r"] for r in table.select("i", mixing._rate(taken, 3).alias("r")).orderBy("i").collect()]
        assert np.allclose(got, mixing.rates(p, taken)[0], rtol=0, atol=1e-12)


def test_a_worker_gives_back_what_arrow_freed(monkeypatch):
    class Pool:
        freed = 0

        def release_unused(self):
            Pool.freed += 1

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    assert list(common.lean(iter("abc"))) == ["a", "b", "c"] and Pool.freed == 3
