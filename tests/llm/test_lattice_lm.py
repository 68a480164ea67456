"""The lattice against enumerating every segmentation, and the query against plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from beaconry.llm import lattice_lm as lm


def segmentations(text, model):
    if not text:
        yield 0.0
    for i in range(1, len(text) + 1):
        if text[:i] in model.pieces:
            p = model.pieces[text[:i]]
        elif i == 1:
            p = sum(model.bytes[b] for b in text[0].encode())
        else:
            continue
        for rest in segmentations(text[i:], model):
            yield p + rest


@pytest.mark.parametrize("word", ["a", "the", "onthe", "x日é", "aaaa", "zz"])
def test_word(word):
    model = lm.Lattice({lm.MARK: -1.0, lm.MARK + "the": -2.0, "the": -2.5, "on": -1.5, "o": -3.0, "n": -3.1, "t": -2.2, "h": -2.3, "e": -1.9, "a": -1.0, "aa": -1.2, "z": -4.0}, [-5.0] * 256)
    paths = list(segmentations(lm.MARK + word, model))
    assert model.word(word) == pytest.approx(math.log(sum(map(math.exp, paths))), abs=1e-9)
    assert model.word("a" * 20_000) < -1000


@pytest.mark.parametrize("frequent", [0, 5, 1000])
def test_query(spark, frequent):
    texts = [(1, "The cat sat on the mat"), (2, None), (3, ""), (4, "the\x0bdog É sat"), (5, "zebra " * 300), (None, "no id"), (11, "cat \x1c cat")] + [(i, f"word{i} the the on") for i in range(20, 50)] + [(1, "The cat sat on the mat")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, word string")
    p = lm.Params(lm.public_vocabulary(), frequent=frequent)
    got = sorted(map(tuple, lm.lm_scores(docs, p=p).collect()), key=str)
    tokens = lambda t: (t or "").encode().lower().split() + [lm.END]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in texts if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    sp = lm.vocabulary(p.vocabulary)
    counts = np.zeros(sp.get_piece_size(), np.int64)
    for w, k in c.items():
        for i in [sp.eos_id()] if w == lm.END else sp.encode(w.decode()):
            counts[i] += k
    model, end = lm.lattice(p.vocabulary, counts), math.log((counts[sp.eos_id()] + 1) / (counts.sum() + len(counts)))
    want = []
    for i, t in texts:
        ws = tokens(t)
        want.append((i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), sum(end if w == lm.END else model.word(w.decode()) for w in ws) / math.log(10)))
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_none(spark):
    assert lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
