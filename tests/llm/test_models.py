"""Held-out accuracy of the classifiers and the mixture's totals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.llm import hashed_text as h
from beaconry.llm import mixing, quality_classifier
from beaconry.llm.common import Stash


def corpus(n=900, seed=4):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = r.choices(words, k=r.randrange(30, 200))
        quality, toxic = int(r.random() < 0.8), int(r.random() < 0.15)
        if not quality:
            w = [x + "|%" for x in w]
        for _ in range(3 * toxic):
            w[r.randrange(len(w))] = r.choice(["vile", "nasty"])
        docs.append((i, " ".join(w), "x"))
        labels.append((i, quality, toxic))
    return docs, labels


def test_ordinal_gradient():
    """Each gradient against differences of the loss."""
    docs, labels = corpus(60)
    rows, _ = h.Rows([d[1] for d in docs]).common(3)
    y = np.array([q + 1 - t for _, q, t in labels])
    g = np.random.default_rng(1)
    w, a = g.normal(size=rows.width) / 10, np.array([-0.7, 0.2])
    _, gw, ga = h.ordinal_loss(rows, y, w, a)
    loss = lambda w, a: h.ordinal_loss(rows, y, w, a)[0]
    for i in range(0, rows.width, 17):
        e = np.zeros(rows.width)
        e[i] = 1e-5
        assert gw[i] == pytest.approx((loss(w + e, a) - loss(w - e, a)) / 2e-5, abs=1e-8)
    for i in range(2):
        e = np.eye(2)[i] * 1e-5
        assert ga[i] == pytest.approx((loss(w, a + e) - loss(w, a - e)) / 2e-5, abs=1e-8)


def test_ordinal_fit_against_a_dense_one():
    """Without the price, the fit's likelihood is that of plain gradient descent on the dense matrix."""
    r = random.Random(3)
    texts = [" ".join(r.choices("abcdef", k=3)) for _ in range(200)]
    y = np.array([min(2, t.count("a") + (r.random() < 0.3)) for t in texts])
    rows, _ = h.Rows(texts).common(3)
    x = np.zeros((len(y), rows.width))
    x[rows.row, rows.slots] = rows.values
    w, c = np.zeros(rows.width), np.array([-0.5, 1.0])

    def tail(w, c):
        return np.concatenate([np.ones((len(y), 1)), 1 / (1 + np.exp(c[None, :] - (x @ w)[:, None])), np.zeros((len(y), 1))], axis=1)

    def likelihood(w, c):
        t = tail(w, c)
        return np.log(t[np.arange(len(y)), y] - t[np.arange(len(y)), y + 1]).mean()

    for _ in range(4000):
        t = tail(w, c)
        at, above, p = np.arange(len(y)), t * (1 - t), None
        p = t[at, y] - t[at, y + 1]
        w = w + 0.3 * x.T @ ((above[at, y] - above[at, y + 1]) / p) / len(y)
        c = c + 0.3 * np.array([((y == k) * above[:, k + 1] / p - (y == k + 1) * above[:, k + 1] / p).sum() for k in range(2)]) / len(y)
    fitted, cuts = h.fit_ordinal(h.Rows(texts), y, 3, h.Training(rounds=3000, rate=0.03, sparsity=0.0))
    own = fitted[h.Rows(texts).common(3)[1]].astype(float)
    assert likelihood(own, cuts) >= likelihood(w, c) - 2e-3


def test_sample_is_bounded_and_the_same(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(7, "y" * 100), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(9, 0), (9, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    texts, y = h.sample(docs, labels, F.col("quality"), h.Training(), Stash(spark))
    assert len(texts) == 49 and texts[7] == "y" * 100  # 9 has two ratings
    some, part = h.sample(docs.repartition(7), labels.repartition(3), F.col("quality"), h.Training(rows=40, bytes=1050), Stash(spark))
    assert len(some) == 10 and len(part) == 10
    assert h.sample(docs.limit(0), labels, F.col("quality"), h.Training(), Stash(spark))[0] == []


def test_ordinal_fit():
    """The fit's thresholds are ordered and its likelihood beats the prior's."""
    docs, labels = corpus(300)
    rows, y = h.Rows([d[1] for d in docs]), np.array([q + 1 - t for _, q, t in labels])
    w, cuts = h.fit_ordinal(rows, y, 3, h.Training())
    assert (np.diff(cuts) > 0).all()
    p = np.diff(np.concatenate([np.ones((len(y), 1)), h.tails(rows, w, cuts), np.zeros((len(y), 1))], axis=1), axis=1) * -1
    assert np.log(p[np.arange(len(y)), y]).mean() > np.log(np.bincount(y)[y] / len(y)).mean() + 0.2


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    extra = [(None, "no id", "x"), (5000, None, "x"), (5001, "", "x"), (0, docs[0][1], "x")]
    return spark.createDataFrame(docs + extra, "doc_id long, text string, row string").cache(), spark.createDataFrame(labels + [(1, None, 0), (None, 1, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int").cache()


def test_grades(spark, tables):
    docs, labels = tables
    graded, g = quality_classifier.grade(docs, labels.filter("doc_id % 3 <> 0"))
    assert graded.count() == docs.count() and quality_classifier.grade(docs.limit(0), labels)[0].count() == 0
    held = graded.select("doc_id", f"{g}.*").dropDuplicates(["doc_id"]).join(labels.filter("doc_id % 3 = 0").dropna(), "doc_id")
    share = {(r["quality"], r["toxic"]): r["k"] for r in held.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1, 0] > 0.95 and max(v for k, v in share.items() if k != (1, 0)) < 0.1
    none, g = quality_classifier.grade(docs, labels.limit(0))
    assert none.select(f"{g}.expected_grade").distinct().count() == 1


def test_mixture(spark, tables):
    docs, labels = tables
    mixed, m = mixing.mix(docs, labels)
    rows = mixed.select("doc_id", f"{m}.*").collect()
    t, p, r = (np.array([x[c] for x in rows]) for c in ("n_tokens", "posteriors", "rate"))
    assert (r >= 0).all() and np.allclose(p.sum(axis=1), 1)
    targets = np.array(list(mixing.TARGETS.values()))
    assert np.allclose((t * r) @ p / t.sum(), targets / targets.sum(), atol=2e-3)
    assert abs(sum(x["copies"] for x in rows) - r.sum()) < 0.1 * len(rows)
    assert mixing.mix(docs.limit(0), labels)[0].count() == 0 and mixing.mix(docs, labels.limit(0))[0].count() == docs.count()


def test_rates_solve_least_squares(spark):
    """Against a plain projected gradient with very many steps, for targets within and out of reach."""
    g = np.random.default_rng(3)
    p = g.dirichlet([0.3, 0.3, 0.3], 60)
    t = g.integers(1, 50, 60)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "t long, p array<double>").coalesce(1).cache()
    weight = np.linalg.inv((p * t[:, None]).T @ p)
    for shares, near in (((0.4, 0.35, 0.25), 1e-4), ((0.7, 0.2, 0.1), 1e-4), ((0.999, 0.0005, 0.0005), 1e-3)):
        goal = np.array(shares) * t.sum()
        miss = lambda r: ((t * r) @ p - goal) @ weight @ ((t * r) @ p - goal)
        plain = np.ones(60)
        for _ in range(20_000):
            plain = np.maximum(0, plain - p @ (weight @ ((t * plain) @ p - goal)))
        found = mixing.solve(members, mixing.Params(targets=dict(zip("abc", shares)), rounds=60), Stash(spark))
        r, _ = mixing.rates(p, found.steps)
        assert (r >= 0).all() and miss(r) <= miss(plain) + near * miss(np.ones(60)) and np.allclose((t * r) @ p, found.totals)
        assert found.settled >= found.met == (found.miss <= 1e-5) and found.miss == pytest.approx(np.abs(found.totals - goal).max() / t.sum())
        assert found.met == (miss(plain) < 1e-9 * miss(np.ones(60)))
    # one document can't meet two targets; with too few rounds nothing is claimed
    one = mixing.solve(spark.createDataFrame([(10, [0.5, 0.5])], "t long, p array<double>"), mixing.Params(targets={"a": 0.9, "b": 0.1}), Stash(spark))
    assert one.settled and not one.met and one.miss == pytest.approx(0.4)
    few = mixing.solve(members, mixing.Params(targets={"a": 0.999, "b": 0.0005, "c": 0.0005}, rounds=2), Stash(spark))
    assert not few.settled and not few.met and few.miss > 1e-5


def test_rare_words_count():
    """Words that five of 1,500 training rows share are learned by both fits."""
    r = random.Random(8)
    markers = [f"vile{i}" for i in range(30)]

    def draw(n):
        bad = [i % 10 == 0 for i in range(n)]
        return h.Rows([" ".join(r.choices([f"w{i}" for i in range(300)], k=20) + [markers[i // 10 % 30]] * b) for i, b in enumerate(bad)]), np.array(bad)

    (rows, bad), (held, out) = draw(1500), draw(600)
    w, cuts = h.fit_ordinal(rows, 2 - bad.astype(int), 3, h.Training())
    kept = h.tails(held, w, cuts)[:, -1] >= 0.5
    w, b = h.fit_softmax(rows, bad.astype(int), 2, mixing.Params().training)
    toxic = h.probabilities(held, w, b)[:, 1] >= 0.5
    for found in (~kept, toxic):
        assert found[out].mean() > 0.8 and found[~out].mean() < 0.05
