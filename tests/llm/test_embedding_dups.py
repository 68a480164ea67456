"""Links, components and recall against brute force, with small blocks so that pairs meet many times."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.llm import embedding_dups as e


def vectors(seed=5):
    g = np.random.default_rng(seed)
    rows, base = [], g.normal(size=(12, 64))
    for i, b in enumerate(base):
        for _ in range(30):  # about the threshold
            x = b / np.linalg.norm(b) + g.normal(size=64) / 8 * g.choice([0.02, 0.1, 0.16])
            rows.append(((3 * x).astype(np.float32).tolist(), i % 3))
    rows += [(g.normal(size=64).astype(np.float32).tolist(), 1) for _ in range(60)] + [rows[0]] * 8
    rows += [(None, 1), ([0.0] * 64, 1), ([float("nan")] + [1.0] * 63, 1), ([None] + [1.0] * 63, 1), (rows[0][0], None), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([], 1), ([float("inf")] * 64, 1)]
    return rows


def brute(rows):
    unit = []
    for v, label in rows:
        ok = label is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0
        unit.append((label, np.array(v, float) / np.linalg.norm(np.array(v, float))) if ok else None)
    links, comp = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] and unit[b] and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.98:
                links[a] += 1
                links[b] += 1
                x, y = sorted((comp[a], comp[b]))
                comp = [x if c == y else c for c in comp]
    return links, comp


@pytest.mark.parametrize("block, small", [(2048, 48), (7, 1)])
def test_links(spark, block, small):
    rows = vectors()
    table = spark.createDataFrame([(i, v, label, "x") for i, (v, label) in enumerate(rows)], "vec_id long, embedding array<float>, label int, keys string")
    got = sorted(map(tuple, e.near_duplicate_vectors(table, p=e.Params(block=block, small=small)).collect()))
    links, comp = brute(rows)
    found, want = sum(x[1] for x in got), sum(links)
    assert found >= 0.999 * want and all(x[1] <= n for x, n in zip(got, links, strict=True))
    assert np.mean([x[2] == c for x, c in zip(got, comp)]) > 0.99 and all(x[3] == (x[0] == x[2]) for x in got)


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(e.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(e.hadamard(e.hadamard(x)), x)


def test_repeated_and_empty(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label long")
    assert sorted(map(tuple, e.near_duplicate_vectors(table).collect()), key=str) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)]
    assert e.near_duplicate_vectors(table.limit(0)).count() == 0


def test_one_vector_for_each_id(spark):
    """Rows of an id are one vector, whichever it is; each row returns its result."""
    g = np.random.default_rng(2)
    v1, v2 = g.normal(size=32), g.normal(size=32)
    table = spark.createDataFrame([(1, v1.tolist(), 3), (1, v2.tolist(), 3), (2, (2 * v2).tolist(), 3), (3, (v1 * 1.5).tolist(), 3), (3, None, 3), (4, [1.0], 3)], "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in e.near_duplicate_vectors(table).collect()]
    assert len(got) == 6 and got.count((4, 0, 4, True)) == 1
    one = (1, 1, 1, True)
    assert got.count(one) == 2 and sum(x[1] for x in got if x[0] in (2, 3)) in (1, 2)
    assert {x for x in got if x[0] in (2, 3)} in ({(2, 1, 1, False), (3, 0, 3, True)}, {(2, 0, 2, True), (3, 1, 1, False)})
    assert sorted(got) == sorted(tuple(r) for r in e.near_duplicate_vectors(table.orderBy(F.rand(3)).repartition(5)).collect())
