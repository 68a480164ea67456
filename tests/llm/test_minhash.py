"""Near-duplicates against brute force over all pairs, with small blocks so that every path runs."""

import random

import numpy as np
import pytest

from beaconry.llm import minhash as m
from beaconry.llm.common import Stash
from beaconry.llm.graph import Unsettled, components


def brute(texts, k, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    return [(len(s), c) for s, c in zip(sets, label)]


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    base = [r.choices(words, k=120) for _ in range(6)]
    texts = [None, "", " \t", "one", "One", "one two", "x " * 2000, "y " * 2000 + "x", "a\x1cb c d e f"]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(25):  # a spread of near copies, some linked, some not
            c = list(b)
            for _ in range(r.randrange(0, 9)):
                c[r.randrange(len(c))] = r.choice(words)
            texts.append(" ".join(c))
    texts += [" ".join(base[0])] * 20
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("k,block", [(4, 512), (5, 7)])
def test_groups(spark, k, block):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, id string, n int")
    got = m.near_duplicates(docs, p=m.Params(words=k, block=block, star=3, passing=8192 if block == 512 else 5, broadcast_ids=0 if block == 7 else 1000))
    want = [(i, n, c, i == c) for i, (n, c) in enumerate(brute(texts, k))]
    assert sorted(map(tuple, got.collect())) == want


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    for size in (1, 3, 40, 5000):
        s = r.integers(0, 2**63, size).astype(np.uint64)
        c = m.sketch(s, 240)
        assert (c != np.iinfo(np.uint64).max).all() and (c == m.sketch(s[::-1].copy(), 240)).all()
    both, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    same = (m.sketch(np.concatenate([both, a]), 240) == m.sketch(np.concatenate([both, b]), 240)).mean()
    assert abs(same - 0.8) < 0.12


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(7, "a b c d e f", 1), (7, "a b c d e f", 1), (3, "a b c d e f", 2), (None, "a b c d e f", 3), (8, None, 4)], "doc_id long, text string, kept int")
    rows = sorted(map(tuple, m.near_duplicates(docs).collect()), key=str)
    assert rows == [(3, 2, 3, True), (7, 2, 3, False), (7, 2, 3, False), (8, 0, 8, True), (None, 2, None, True)]
    assert m.near_duplicates(docs.limit(0)).count() == 0
    kept = m.stage(spark, docs.union(docs.filter("doc_id = 3")), "")
    assert kept.columns == docs.columns and sorted((str(r["doc_id"]) for r in kept.collect())) == ["3", "8", "None"]


def test_one_text_for_each_id(spark):
    """Sketch, set and stage speak of the same text of an id, the greatest."""
    a, b = "a b c d e f g h i j", "z y x w v u t s r q"
    docs = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a), (4, None), (4, a)], "doc_id long, text string")
    assert sorted(map(tuple, m.near_duplicates(docs).collect())) == [(1, 6, 1, True), (1, 6, 1, True), (2, 6, 1, False), (3, 6, 3, True), (4, 6, 3, False), (4, 6, 3, False)]
    assert sorted(map(tuple, m.stage(spark, docs, "").collect())) == [(1, b), (3, a)]


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "u long, v long")
    assert {r["component"] for r in components(edges, Stash(spark)).collect()} == {0}
    with pytest.raises(Unsettled):
        components(edges, Stash(spark), most=2)
