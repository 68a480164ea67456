"""Hashed features of whole texts, and linear heads trained on a bounded labelled sample.

A text's features are the presence of its lower-cased words without marks at their ends, hashed into 2^20 slots, and the share of its
words that have each shape (their first marks, and whether they have letters or digits), hashed into 2^10 slots.
A worker remembers a bounded number of words. Training is full-batch Adam on the driver over at most
``rows`` labelled rows, those with the smallest hash of their id; slots that fewer than ``least`` of them
share keep no weight, so rare words can't be learned by heart. Everything else covers all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, quoted

WORDS, SHAPES = 1 << 20, 1 << 10
DIM = WORDS + SHAPES
WORD_CACHE = 400_000
#: Characters that a word's ends lose before it is hashed; its shape keeps them.
EDGES = b""".,;:!?"'()[]{}|#*$%&<>-_"""


@dataclass(frozen=True)
class Training:
    #: Labelled rows at most, and bytes of their texts.
    rows: int = 8_000
    bytes: int = 64 << 20
    rounds: int = 300
    rate: float = 0.1
    #: Price of a weight's size (an L1 penalty): words that don't help get none.
    sparsity: float = 1e-3
    #: The price in rows, where that is less: as a fixed prior, it weighs less the more rows there are.
    evidence: float = 0.8
    #: Texts that must share a slot, however many there are.
    least: int = 3


_PLAIN = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))


def shape(word: bytes) -> bytes:
    """The first marks of a word, and whether it has letters or digits besides."""
    marks = word.translate(None, _PLAIN)
    return marks[:3] + b"a" if len(marks) < len(word) else marks[:3]


class _Slots(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = n = xxhash.xxh3_64_intdigest(word.strip(EDGES) or word) % WORDS << 32 | xxhash.xxh3_64_intdigest(shape(word)) % SHAPES
        return n


_slots = _Slots()


def forget_words() -> None:
    _slots.clear()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Slots, their values, and the number of words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    both = np.fromiter(map(_slots.__getitem__, words), np.int64, len(words))
    present = np.unique(both >> 32)
    times = np.bincount(both & 0xFFFFFFFF, minlength=SHAPES)
    shapes = np.flatnonzero(times)
    return np.concatenate([present, WORDS + shapes]), np.concatenate([np.ones(len(present)), 4 * np.sqrt(times[shapes] / max(1, len(words)))]), len(words)


class Rows:
    """Sparse rows; ``dot`` and its transpose without a dense matrix."""

    def __init__(self, texts: list):
        parts = [features(t) for t in texts]
        self.slots = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
        self.values = np.concatenate([p[1] for p in parts]) if parts else np.empty(0)
        self.words = np.array([p[2] for p in parts], np.int64)
        self.row = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        self.width = DIM

    def common(self, least: int) -> tuple["Rows", np.ndarray]:
        """The rows over the slots that ``least`` rows share, renumbered, and those slots."""
        shared = np.bincount(self.slots, minlength=DIM) >= least
        kept, out = shared[self.slots], object.__new__(Rows)
        slots = np.flatnonzero(shared)
        out.slots, out.values, out.row, out.words, out.width = np.searchsorted(slots, self.slots[kept]), self.values[kept], self.row[kept], self.words, len(slots)
        return out, slots

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.slots], len(self.words))

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.slots, self.values * g[self.row], self.width)


def spread(w: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Weights of ``slots`` as weights of all slots."""
    out = np.zeros((*w.shape[:-1], DIM), np.float32)
    out[..., slots] = w
    return out


def _adam(x: list[np.ndarray], gradient, n: int, t: Training) -> list[np.ndarray]:
    """Full-batch Adam; the weights (the first of ``x``) shrink towards 0 after each step, so most end there."""
    price = min(t.sparsity, t.evidence / n)
    m, v = [np.zeros_like(s) for s in x], [np.zeros_like(s) for s in x]
    for i in range(1, t.rounds + 1):
        for j, g in enumerate(gradient(x)):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.999 * v[j] + 0.001 * g * g
            step = t.rate / (np.sqrt(v[j] / (1 - 0.999**i)) + 1e-8)
            x[j] = x[j] - step * m[j] / (1 - 0.9**i)
            if j == 0:
                x[j] = np.sign(x[j]) * np.maximum(np.abs(x[j]) - step * price, 0.0)
    return x


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_softmax(rows: Rows, y: np.ndarray, classes: int, t: Training) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes x DIM) and offsets of a multinomial regression."""
    n = max(1, len(y))
    rows, slots = rows.common(t.least)
    prior = np.log((np.bincount(y, minlength=classes) + 1) / (len(y) + classes))

    def gradient(x):
        w, b = x
        e = probabilities(rows, w, b)
        e[np.arange(len(y)), y] -= 1
        return [np.stack([rows.back(e[:, k]) for k in range(classes)]) / n, e.sum(axis=0) / n]

    w, b = _adam([np.zeros((classes, rows.width)), prior], gradient, n, t)
    return spread(w, slots), b


def probabilities(rows: Rows, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = np.stack([rows.dot(k) for k in w], axis=1) + b
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def ordered_cuts(a: np.ndarray) -> np.ndarray:
    """Increasing thresholds: the first, and the logarithms of the steps to the others."""
    return a[0] + np.concatenate([[0.0], np.cumsum(np.exp(a[1:]))])


def ordinal_loss(rows: Rows, y: np.ndarray, w: np.ndarray, a: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades ``y``, and its gradients by the weights and by ``a``."""
    n = max(1, len(y))
    c = np.concatenate([[-np.inf], ordered_cuts(a), [np.inf]])
    z = rows.dot(w)
    hi, lo = sigmoid(c[y + 1] - z), sigmoid(c[y] - z)
    p = np.maximum(hi - lo, 1e-9)
    dh, dl = hi * (1 - hi) / p, lo * (1 - lo) / p  # d log p by the upper and by the lower threshold
    by_cut = np.array([-(dh[y == k].sum() - dl[y == k + 1].sum()) for k in range(len(a))]) / n
    ga = np.concatenate([[by_cut.sum()], np.exp(a[1:]) * np.cumsum(by_cut[::-1])[::-1][1:]])
    return -np.log(p).mean(), rows.back(dh - dl) / n, ga


def fit_ordinal(rows: Rows, y: np.ndarray, grades: int, t: Training) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and increasing thresholds: P(grade <= k) = sigmoid(threshold_k - w.x)."""
    n = max(1, len(y))
    rows, slots = rows.common(t.least)
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / n, 0.01, 0.99)
    first = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 0.05))
    w, a = _adam([np.zeros(rows.width), np.concatenate([first[:1], gaps])], lambda x: ordinal_loss(rows, y, *x)[1:], n, t)
    return spread(w, slots), ordered_cuts(a)


def tails(rows: Rows, w: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade >= 1), P(grade >= 2), ... as columns."""
    return sigmoid(rows.dot(w)[:, None] - cuts[None, :])


def sample(docs: DataFrame, labels: DataFrame, rating, t: Training, stash: Stash, id_col: str = "doc_id", text_col: str = "text") -> tuple[list, np.ndarray]:
    """Texts and ratings of at most ``t.rows`` labelled documents of ``t.bytes``, by the smallest hash of their id.

    rating: a column of ``labels``, null where unusable. Ids with several ratings don't train; of several texts of an id the greatest does.
    """
    key = F.col(quoted(id_col)).alias("id")
    named = labels.select(key, rating.cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("id", "y")
    some = named.orderBy(F.xxhash64("id"), "id").limit(t.rows)
    texts = docs.select(key, F.col(quoted(text_col)).cast("string").alias("text"))
    got = stash.put(texts.join(F.broadcast(some), "id").groupBy("id", "y").agg(F.max("text").alias("text")))
    sizes = got.select(F.xxhash64("id").alias("hash"), "id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy("hash", "id").collect()
    total, last = 0, None
    for r in sizes:
        total += r["size"]
        if total > t.bytes:
            break
        last = r
    if last is None:
        return [], np.empty(0, np.int64)
    at = F.xxhash64("id")
    rows = got.filter((at < last["hash"]) | (at == last["hash"]) & (F.col("id") <= last["id"])).orderBy("id").collect()
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64)
