"""Mixing to target weights by soft membership.

A multinomial classifier on hashed text, trained on labelled rows, gives every document posteriors over the
domains. Document rates r >= 0 then minimise the weighted least squares between the expected domain tokens
sum_d r_d t_d p_d and the targets, by projected gradient steps from r = 1. In the variables
sqrt(t_d) r_d, with the inverse of sum_d t_d p_d p_d' as the weight of the squares, the step length is one
and a step is r_d <- max(0, r_d - p_d . v) with a vector v of one number per domain. A step first tries that sum over the documents
whose rate isn't 0, which meets the targets at once if no rate reaches 0. The first such step that doesn't bring the targets
nearer is taken back, and from there steps use the sum over all documents, from points that momentum has moved ahead (Nesterov's,
which starts anew whenever the targets get farther).

A rate is a function of the posteriors and of the vectors so far: each round is one aggregation over all documents, only domain
totals reach the driver, rates are written every few rounds (so that no round replays many), and a lost executor costs its tasks.

Rounds end when the targets are met within ``close`` of all tokens, or when the rates rest: then the targets are out of reach,
and the rates are those of the least weighted squares. ``Solution`` tells which, with the totals reached, the targets and the largest miss, which
``mix`` also gives with every row; after ``rounds`` rounds neither may hold, and ``settled`` is false.

Defined results: a null text is an empty one (one token, its end); repeated rows have a rate each; labels
with nulls, with several ratings of one id or without a document don't train; without labels all posteriors are equal; an
empty table gives no rows; other columns pass through ``mix`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_ROWS, Stash, fresh, lean, own, quoted, sole
from .hashed_text import DIM, Rows, Training, fit_softmax, forget_words, probabilities, sample

#: Domains by the labels (quality, toxic), with their share of tokens in the mixture.
TARGETS = {"poor": 0.05, "poor_toxic": 0.005, "good": 0.93, "good_toxic": 0.015}


@dataclass(frozen=True)
class Params:
    targets: dict = field(default_factory=lambda: dict(TARGETS))
    training: Training = Training(rounds=150)
    rounds: int = 100
    #: Miss of a target, in shares of all tokens, and mean change of the rates, that end the rounds.
    close: float = 1e-5
    rest: float = 1e-6
    #: Rounds between two tables of the rates.
    written: int = 6


@dataclass(frozen=True)
class Solution:
    """The steps' vectors, and what they reach: tokens by domain, the targets, the largest miss in shares of all tokens."""

    steps: list
    totals: np.ndarray
    targets: np.ndarray
    miss: float
    met: bool
    settled: bool


def _posteriors(batches, shared, domains: int, at: int | None):
    """``t, p, row`` of rows ``row`` whose text is column ``at`` of the row, or of ``row, x`` with the text beside it."""
    sole(forget_words)
    w, b = shared.value
    for batch in lean(batches):
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            rows = Rows((part.column(1) if at is None else part.column(0).field(at)).to_pylist())
            p = probabilities(rows, w, b)
            arrays = [pa.array(rows.words + 1), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), domains).cast(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*arrays, part.column(0)], ["t", "p", "row"])


def rates(p: np.ndarray, steps: list[tuple[float, np.ndarray]], r: np.ndarray | None = None, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rates after ``steps`` (momentum and vector of each), and those before the last step."""
    r = np.ones(len(p)) if r is None else r
    before = r if before is None else before
    for momentum, v in steps:
        r, before = np.maximum(0.0, r + momentum * (r - before) - p @ v), r
    return r, before


def _matrix(batch, at: int, domains: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)


def _state(batches, steps, domains: int):
    """``t, p, r, b`` with the steps taken."""
    for batch in batches:
        r, b = rates(_matrix(batch, 1, domains), steps, batch.column(2).to_numpy(), batch.column(3).to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(r), pa.array(b)], ["t", "p", "r", "b"])


def _totals(batches, steps, domains: int):
    """Tokens, tokens times the last step's change, domain tokens, then sum t p p' over all documents and over those with a rate."""
    tokens, moved, total = 0.0, 0.0, np.zeros(domains)
    square, active = np.zeros((domains, domains)), np.zeros((domains, domains))
    for batch in batches:
        t, p = batch.column(0).to_numpy().astype(float), _matrix(batch, 1, domains)
        r, before = rates(p, steps, batch.column(2).to_numpy(), batch.column(3).to_numpy())
        tokens, moved, total = tokens + t.sum(), moved + t @ np.abs(r - before), total + (t * r) @ p
        square += (p * t[:, None]).T @ p
        active += (p * (t * (r > 0))[:, None]).T @ p
    yield pa.RecordBatch.from_arrays([pa.array([[tokens, moved, *total, *square.ravel(), *active.ravel()]], pa.list_(pa.float64()))], ["x"])


def solve(members: DataFrame, params: Params, stash: Stash) -> Solution:
    """The steps for ``members`` (t, p; stashed)."""
    k = len(params.targets)
    weights = np.array(list(params.targets.values()), float)
    inverse = lambda m: np.linalg.pinv(m.reshape(k, k), rcond=1e-10)
    state = members.select("t", "p", F.lit(1.0).alias("r"), F.lit(1.0).alias("b"))
    table, steps, pending = None, [], []
    best, trial, count, n = None, True, 0, 2 + k + 2 * k * k
    for i in range(params.rounds + 1):
        parts = state.mapInArrow(lambda b, s=list(pending): _totals(b, s, k), "x array<double>")
        x = np.array(parts.agg(F.array(*[F.sum(F.col("x")[j]) for j in range(n)]).alias("x")).first()["x"], float)
        if not x[0] > 0:  # no rows
            return Solution([], np.zeros(k), np.zeros(k), 0.0, True, True)
        total, target = x[2 : 2 + k], weights / weights.sum() * x[0]
        square, active = inverse(x[2 + k : 2 + k + k * k]), x[2 + k + k * k :]
        miss, value, moved = np.abs(total - target).max() / x[0], (total - target) @ square @ (total - target), x[1] / x[0]
        met, rests = miss <= params.close, i > 0 and moved <= params.rest
        if trial and best and not met and not value < 0.9 * best[1]:  # back to the rates before, and on with momentum
            pending.pop(), steps.pop()
            total, value, miss = best
            trial, rests = False, False
        if met or rests or i == params.rounds:
            return Solution(steps, total, target, float(miss), bool(met), bool(met or rests))
        if len(pending) >= params.written:
            old, table = table, stash.put(state.mapInArrow(lambda b, s=list(pending): _state(b, s, k), "t long, p array<double>, r double, b double"))
            state, pending = table, []
            if old is not None:
                stash.forget(old)
        if trial:
            step = 0.0, inverse(active) @ (total - target)
        else:
            count = 0 if value > best[1] else count + 1
            momentum = max(0, count - 1) / (count + 2)
            step = momentum, square @ (total + momentum * (total - best[0]) - target)
        best = total, value, miss
        pending.append(step), steps.append(step)


def _rate(steps: list[tuple[float, np.ndarray]], domains: int, p: str = "p") -> Column:
    """The rate after ``steps`` by the posteriors in column ``p``: only they go to a worker. Not evaluated once more by filters."""

    def rate(x: pa.Array) -> pa.Array:
        return pa.array(rates(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, domains), steps)[0])

    return F.arrow_udf(rate, "double").asNondeterministic()(p)


def mix(docs: DataFrame, labels: DataFrame, params: Params | None = None, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with a struct (its name is returned too): n_tokens, posteriors, rate, copies, target_miss.

    ``copies`` rounds the rate up or down by a hash of the id, so that its expectation is the rate; ``target_miss`` is the
    largest miss of a target by the rates, in shares of all tokens, the same in every row.
    """
    params = params or Params()
    k = len(params.targets)
    stash = Stash(docs.sparkSession)
    rating = F.when(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1), 2 * F.col("quality") + F.col("toxic"))
    texts, y = sample(docs, labels, rating, params.training, stash, id_col, text_col)
    model = fit_softmax(Rows(texts), y, k, params.training) if len(y) else (np.zeros((k, DIM)), np.zeros(k))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = fresh(docs, "__mix")
    inner = docs.select(F.struct(*own(docs)).alias("row"))
    at = docs.columns.index(text_col) if dict(docs.dtypes).get(text_col) == "string" else None
    schema = inner.select(F.lit(0).cast("long").alias("t"), F.lit(None).cast("array<double>").alias("p"), "row").schema
    if at is None:
        inner = docs.select(F.struct(*own(docs)).alias("row"), F.col(quoted(text_col)).cast("string").alias("x"))
    members = stash.put(inner.mapInArrow(lambda b: _posteriors(b, shared, k, at), schema), TEXT_ROWS)
    found = solve(members.select("t", "p"), params, stash)
    rated = members.select(_rate(found.steps, k).alias("r"), "t", "p", "row")
    part = F.pmod(F.xxhash64(F.col("row")[id_col], F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    mixed = F.struct(F.col("t").alias("n_tokens"), F.col("p").alias("posteriors"), F.col("r").alias("rate"), F.floor(F.col("r") + part).cast("int").alias("copies"), F.lit(found.miss).alias("target_miss"))
    return rated.select("row.*", mixed.alias(out)), out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as its rate says."""
    mixed, m = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    n = fresh(mixed, "__copy")
    often = mixed.filter(F.col(f"{m}.copies") > 0)
    return often.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(f"{m}.copies")))).select(*own(docs))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its posteriors, rate and copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed, m = mix(docs, labels)
    return mixed.select("doc_id", f"{m}.n_tokens", *[F.col(f"{m}.posteriors")[i].alias(f"p_{k}") for i, k in enumerate(TARGETS)], f"{m}.rate", f"{m}.copies", f"{m}.target_miss")


QUERIES = {"op1_mixing": op1_mixing}
SQL: dict[str, str] = {}
