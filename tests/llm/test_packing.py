"""Packing: nothing lost, nothing overlaps, bins fit, and the cost against the optimum and against single lengths."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from beaconry.llm import packing as k
from beaconry.llm import token_ids

P = k.Params(lengths=(8, 16, 32), overhead=1, shard_pieces=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_pack(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, offsets, final = k.pack(sizes, P)
    held = {}
    for s, b, o, f in zip(sizes, bins.tolist(), offsets.tolist(), final.tolist()):
        held.setdefault((b, f), []).append((o, s))
    assert len({b for b, _ in held}) == len(held)
    for (_, f), parts in held.items():
        end = 0
        for o, s in sorted(parts):
            assert o == end
            end += s
        assert end <= f and f in P.lengths and not any(c >= end for c in P.lengths if c < f)


def cost(sizes, packed, p):
    return sum(p.cost(f) for _, f in {(b, f) for b, f in zip(packed[0].tolist(), packed[2].tolist())})


def optimum(sizes, p):
    """The least cost of all partitions into bins."""
    top, best = max(p.lengths), [float("inf")]

    def go(rest, bins):
        if not rest:
            best[0] = min(best[0], sum(p.cost(min(c for c in p.lengths if c >= b)) for b in bins))
            return
        for i in range(len(bins)):
            if bins[i] + rest[0] <= top:
                go(rest[1:], bins[:i] + [bins[i] + rest[0]] + bins[i + 1 :])
        go(rest[1:], [*bins, rest[0]])

    go(sizes, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=7))
def test_near_the_optimum(sizes):
    p = k.Params(lengths=(8, 16, 32), overhead=1, attention=64)
    sizes = sorted(sizes, reverse=True)
    assert optimum(sizes, p) - 1e-9 <= cost(sizes, k.pack(sizes, p), p) <= 1.5 * optimum(sizes, p)


def test_several_lengths_are_used_and_pay():
    r = random.Random(4)
    sizes = sorted([r.randrange(20, 400) for _ in range(3000)] + [r.randrange(1000, 6000) for _ in range(150)], reverse=True)
    p = k.Params()
    packed = k.pack(sizes, p)
    bins = dict(zip(packed[0].tolist(), packed[2].tolist()))
    share = {c: list(bins.values()).count(c) / len(bins) for c in p.lengths}
    assert sum(x > 0.03 for x in share.values()) >= 3
    assert sum(sizes) / sum(bins.values()) > 0.97
    assert cost(sizes, packed, p) <= min(cost(sizes, k.pack(sizes, p, (c,)), p) for c in p.lengths)
    single = k.Params(lengths=(8192,))
    assert cost(sizes, packed, p) < 0.97 * cost(sizes, k.pack(sizes, single), single)


def test_documents(spark):
    r = random.Random(1)
    lengths = [(i, r.choice([1, 3, 7, 20, 33, 64, 65, 200])) for i in range(300)] + [(None, 5), (7, 9), (7, 9)]
    rows = k.best_fit(spark.createDataFrame(lengths, "id long, n long"), P).collect()
    total = {}
    for x in rows:
        assert x["start"] == 32 * x["piece"] and 1 <= x["length"] <= 32
        total[x["id"]] = total.get(x["id"], 0) + x["length"]
    want = {}
    for i, n in lengths:
        want[i] = want.get(i, 0) + n
    assert total == want
    bins = {x["bin_id"]: x["bin_length"] for x in rows}
    assert sum(bins.values()) < 1.1 * sum(n for _, n in lengths) and len({b >> 32 for b in bins}) > 1
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a b\tc", 3)], "doc_id long, text string, length int")
    ids = {r["id"]: r["ids"] for r in token_ids.encoded(docs, token_ids.Params(token_ids.public_vocabulary())).collect()}
    packed = k.pack_documents(docs)
    assert {x["doc_id"]: x["length"] for x in packed.collect()} == {i: len(v) for i, v in ids.items()}
    (bin_,) = k.sequences(docs, packed).collect()
    at = {x["doc_id"]: x["offset"] for x in packed.collect()}
    assert bin_["bin_length"] == 512 and all(bin_["ids"][at[i] : at[i] + len(v)] == v for i, v in ids.items())
    table = spark.createDataFrame([], "doc_id long, text string, length int")
    assert k.pack_documents(table).count() == 0
    assert k.pack_documents(docs.limit(0)).count() == 0
