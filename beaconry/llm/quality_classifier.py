"""Quality classifier: ordinal cumulative-link regression on graded ratings.

The rating of a labelled document is quality + 1 - toxic: 0 for poor and toxic, 1 for one of both faults, 2
for good and clean. One weight per hashed feature is shared by all grades and ordered thresholds cut the
score: P(grade <= k) = sigmoid(threshold_k - w.x). A document's expected grade is the sum of its tail
probabilities, and it is selected by the tail of the best grade.

Defined results: a null text is an empty one; repeated rows are judged each; labels with nulls or without a
document don't train, and without any every document gets the same grade; an empty table gives no rows;
other columns pass through ``grade`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, fresh, own, quoted, sole
from .hashed_text import DIM, Rows, Training, fit_ordinal, forget_words, sample, tails

GRADES = 3


@dataclass(frozen=True)
class Params:
    training: Training = Training()
    #: Least probability of the best grade that keeps a document.
    least: float = 0.5


def _graded(batches, shared):
    sole(forget_words)
    w, cuts = shared.value
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            p = tails(Rows(part.column(0).to_pylist()), w, cuts)
            yield pa.RecordBatch.from_arrays([pa.array(p.sum(axis=1)), pa.array(p[:, -1]), *(part.column(i) for i in range(1, part.num_columns))], ["expected", "tail", *part.schema.names[1:]])


def grade(docs: DataFrame, labels: DataFrame, params: Params | None = None, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with a struct (its name is returned too): expected_grade, tail_probability, kept."""
    params = params or Params()
    rating = F.when(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1), F.col("quality") + 1 - F.col("toxic"))
    texts, y = sample(docs, labels, rating, params.training, Stash(docs.sparkSession), id_col, text_col)
    model = fit_ordinal(Rows(texts), y, GRADES, params.training) if len(y) else (np.zeros(DIM), np.array([-1.0, 0.0]))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = fresh(docs, "__grade")
    inner = docs.select(F.col(quoted(text_col)).cast("string").alias("x"), F.struct(*own(docs)).alias("row"))
    schema = inner.select(F.lit(0.0).alias("expected"), F.lit(0.0).alias("tail"), "row").schema
    graded = inner.mapInArrow(lambda b: _graded(b, shared), schema)
    return graded.select("row.*", F.struct(F.col("expected").alias("expected_grade"), F.col("tail").alias("tail_probability"), (F.col("tail") >= params.least).alias("kept")).alias(out)), out


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    graded, g = grade(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return graded.select("doc_id", f"{g}.expected_grade", f"{g}.tail_probability", f"{g}.kept")


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
SQL: dict[str, str] = {}
