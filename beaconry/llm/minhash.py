"""Near-duplicate texts by fast similarity sketches, banding and exact verification.

Sketch: t coordinates (bins). In round i = 0..t-1 every shingle is thrown into one bin, in round
t..2t-1 every shingle goes into bin i - t, and a bin keeps the smallest value of the first round that
reaches it. So each bin fills after 2t rounds at most, nearly always after the few rounds that throw about
t ln t shingles, and equal coordinates estimate the Jaccard similarity with the concentration of
sampling without replacement.

Documents with equal shingle sets become one class at once. The classes' sketches are cut into bands;
classes that share a band are candidates. Each band's members are compared with its smallest id (a star,
not all pairs), and what that verifies is joined into components. Where a band still holds several
components, the members outside of the band's largest component are compared, in blocks of bounded size, with all
members of other components: a block holds the sets of its outsiders, intersects the others' sets with them by counting as
they pass by, and returns only links that join components. So every candidate pair ends in one component or has been compared on
full sets, and a band of near copies costs its size times its few outsiders. Sets are hashed once and move as
arrays. With 40 bands of 6 rows a pair at similarity 0.8 is missed with probability 5e-6.

Defined results: null and blank texts have the empty set and link with nothing; rows without an id link
with nothing, have no component and are kept; rows that repeat an id are one document, its greatest text; ties don't
matter (the smallest id names the component); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_ROWS, Stash, own, quoted, sole
from .graph import components

U = np.uint64
_MIX1, _MIX2, _STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
#: How many distinct words a worker remembers at once.
WORD_CACHE = 200_000


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    #: Outsiders, and their shingles, that one block of a band holds, and members that pass by it in one task.
    block: int = 512
    block_shingles: int = 1 << 20
    passing: int = 8192
    #: Members that one copy of a centre serves.
    star: int = 100
    #: Ids (8 bytes each) that may be broadcast.
    broadcast_ids: int = 500_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (splitmix)."""
    x = (x ^ (x >> U(30))) * _MIX1
    x = (x ^ (x >> U(27))) * _MIX2
    return x ^ (x >> U(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words form one shingle, none no shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(_words.__getitem__, words), U, len(words))
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, U)
    for i in range(min(k, len(h))):
        out = mix(out * _STEP + h[i : i + n])
    return np.unique(out)


def sketch(shingles: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of a set that isn't empty."""
    n, low = len(shingles), U(54)
    out = np.full(t, np.iinfo(U).max, U)
    start = 0
    while start < t:
        rounds = min(t - start, max(1, math.ceil(t * (math.log(t) + 2) / n)))
        i = np.arange(start, start + rounds, dtype=U)
        h = mix(shingles[None, :] ^ mix((i + U(1)) * _STEP)[:, None])
        place = (((h >> U(32)) * U(t)) >> U(32)).astype(np.intp)
        value = (i[:, None] << low) | (h & ((U(1) << low) - U(1)))
        np.minimum.at(out, place.ravel(), value.ravel())
        start += rounds
        if (out < U(np.iinfo(U).max)).all():
            return out
    for j in np.flatnonzero(out == np.iinfo(U).max):  # rounds t..2t-1
        h = mix(shingles ^ mix(np.array([t + j + 1], U) * _STEP))
        out[j] = (U(t + j) << low) | (h & ((U(1) << low) - U(1))).min()
    return out


def band_keys(coordinates: np.ndarray, p: Params) -> np.ndarray:
    part = coordinates[: p.bands * p.rows].reshape(p.bands, p.rows)
    key = mix(np.arange(1, p.bands + 1, dtype=U) * _STEP)
    for c in range(p.rows):
        key = mix(key * _STEP + part[:, c])
    return key.view(np.int64)


def _sketches(batches, p: Params):
    sole(_words.clear)
    for batch in batches:
        n, prints, keys = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, p.words)
            n.append(len(s))
            if len(s):
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(band_keys(sketch(s, p.bands * p.rows), p))
            else:
                prints.append(None), keys.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["id", "n", "print", "bands"],
        )


def _sets(batches, p: Params):
    """``id, set``: the shingles' hashes as bytes."""
    sole(_words.clear)
    for batch in batches:
        sets = [shingle_set(t, p.words).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])


def _set(data) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), U)


def _verify(batches, p: Params):
    """Rows sorted by centre, salt and role: a centre's set, then the members that it is compared with."""
    centre, of = None, None
    for batch in batches:
        a, b = [], []
        cs, roles, ids = (batch.column(i).to_pylist() for i in range(3))
        for c, role, i, data in zip(cs, roles, ids, batch.column(3)):
            if role == 0:
                centre, of = _set(data), c
                continue
            assert of == c
            s = _set(data)
            if 100 * min(len(s), len(centre)) < p.percent * max(len(s), len(centre)):
                continue
            both = len(np.intersect1d(s, centre, assume_unique=True))
            if 100 * both >= p.percent * (len(s) + len(centre) - both):
                a.append(max(i, c)), b.append(min(i, c))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])


def _few(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has few enough rows."""
    return F.broadcast(df) if df.count() <= most else df


def verified(pairs: DataFrame, sets: DataFrame, p: Params, stash: Stash) -> DataFrame:
    """Those of ``pairs`` (c, i; stashed) whose full sets are similar enough, as u > v. sets: id, set.

    Each member's set moves once to its centre; a centre with many members is copied to several tasks.
    """
    load = stash.put(pairs.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / p.star).cast("int").alias("salts")))
    centres = load.join(sets, load.c == sets.id).select("c", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("id").alias("i"), "set")
    members = pairs.join(_few(load, p.broadcast_ids), "c").join(sets, pairs.i == sets.id).select(
        "c", F.pmod(F.xxhash64("i"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), "i", "set"
    )
    rows = centres.union(members).repartition("c", "salt").sortWithinPartitions("c", "salt", "role")
    return rows.select("c", "role", "i", "set").mapInArrow(lambda b: _verify(b, p), "u long, v long")


class _Block:
    """The outsiders of one block of one band, and the components that its links have joined."""

    def __init__(self):
        self.ids, self.labels, self.sets, self.root, self.ready = [], [], [], {}, False

    def add(self, i: int, label: int, s: np.ndarray) -> None:
        self.ids.append(i), self.labels.append(label), self.sets.append(s)

    def find(self, label: int) -> int:
        while (up := self.root.get(label, label)) != label:
            self.root[label] = self.root.get(up, up)
            label = up
        return label

    def _index(self) -> None:
        self.sizes = np.array([len(s) for s in self.sets])
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        flat = np.concatenate(self.sets)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.values, self.starts = np.unique(flat[order], return_index=True)
        self.counts = np.diff(np.append(self.starts, len(flat)))
        self.ready = True

    def links(self, i: int, label: int, s: np.ndarray, p: Params):
        """Links of a member that passes by, at most one for each component that it joins."""
        if not self.ready:
            self._index()
        if not len(self.values):
            return
        near = 100 * np.minimum(self.sizes, len(s)) >= p.percent * np.maximum(self.sizes, len(s))
        if not near.any():
            return
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        at = at[self.values[at] == s]
        n = self.counts[at]
        spots = np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(self.owner[spots], minlength=len(self.sets))
        for y in np.flatnonzero(near & (100 * both >= p.percent * (self.sizes + len(s) - both))):
            a, b = self.find(label), self.find(self.labels[y])
            if a != b:
                self.root[max(a, b)] = min(a, b)
                yield max(i, self.ids[y]), min(i, self.ids[y])


def _blocks(batches, p: Params):
    """``u, v`` of rows sorted by key, block, part and role: a block's outsiders, then the members that pass by."""
    block, of = None, None
    for batch in batches:
        found = set()
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for key, number, part, role, i, label, data in zip(*columns, batch.column(6)):
            if of != (key, number, part):
                block, of = _Block(), (key, number, part)
            if role == 0:
                block.add(i, label, _set(data))
            else:
                found.update(block.links(i, label, _set(data), p))
        u, v = zip(*sorted(found)) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def one_text(docs: DataFrame, id_col: str, text_col: str, p: Params, stash: Stash) -> tuple[DataFrame, DataFrame | None]:
    """``id, text`` with one row for each id (and all rows without one), and the ids that repeat with their rows' number."""
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    again = stash.put(texts.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    if again.isEmpty():
        return texts, None
    ids = _few(again.select("id"), p.broadcast_ids)
    repeated = texts.join(ids, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    return texts.join(ids, "id", "left_anti").unionByName(repeated), again


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params | None = None, stash: Stash | None = None) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``docs``; it reads tables of ``stash``."""
    p = p or Params()
    stash = stash or Stash(docs.sparkSession)
    texts, again = one_text(docs, id_col, text_col, p, stash)
    rows = stash.put(texts.mapInArrow(lambda b: _sketches(b, p), "id long, n long, print binary, bands array<long>"), TEXT_ROWS)
    # classes of equal sets
    copies = stash.put(rows.filter("id IS NOT NULL AND n > 0").groupBy("print").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"))
    member = stash.put(rows.select("id", "n", "print").join(copies, "print", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")))
    # rows of copies that stand for no class; few beside the others, and never the others' bands
    idle = stash.put(member.filter("id <> rep").select("id"))
    reps = stash.put(rows.filter("id IS NOT NULL AND n > 0").join(_few(idle, p.broadcast_ids), "id", "left_anti").select("id", "n", "bands"))
    # bands shared by two classes or more
    banded = reps.select("id", "n", F.explode("bands").alias("key"))
    shared = stash.put(banded.groupBy("key").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = stash.put(banded.join(shared, "key").select("key", "id", "n", "c"))
    pairs = stash.put(members.filter("id <> c").select("c", F.col("id").alias("i")).distinct())
    ids = stash.put(members.select("id").distinct())
    sets = stash.put(texts.join(_few(ids, p.broadcast_ids), "id", "left_semi").mapInArrow(lambda b: _sets(b, p), "id long, set binary"), TEXT_ROWS)
    edges = stash.put(verified(pairs, sets, p, stash))
    label = components(edges, stash)

    # bands that still hold several components
    at = stash.put(members.join(label, members.id == label.node, "left").select("key", "id", "n", F.coalesce("component", "id").alias("component")))
    groups = at.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    mixed = groups.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("all"), F.sum("n").alias("total"), F.max(F.struct("size", "n", "component")).alias("main")).filter("groups > 1")
    out_rows, out_n = F.col("all") - F.col("main.size"), F.col("total") - F.col("main.n")
    parts = F.ceil(F.greatest(F.col("all") / p.passing, F.col("total") / (p.passing * 64)))
    mixed = stash.put(mixed.select("key", F.col("main.component").alias("main"), F.ceil(F.greatest(out_rows / p.block, out_n / p.block_shingles)).cast("int").alias("nb"), parts.cast("int").alias("np")))
    left = stash.put(at.join(mixed, "key"))
    if not left.isEmpty():
        numbered = lambda salt, of: F.pmod(F.xxhash64("id", "key", F.lit(salt)), F.col(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        outside = left.filter("component <> main").select("key", numbered(0, "nb").alias("block"), every("np").alias("part"), F.lit(0).alias("role"), "id", "component")
        passing = left.select("key", every("nb").alias("block"), numbered(1, "np").alias("part"), F.lit(1).alias("role"), "id", "component")
        laid = outside.union(passing).join(sets, "id").repartition("key", "block", "part").sortWithinPartitions("key", "block", "part", "role")
        joins = laid.select("key", "block", "part", "role", "id", "component", "set").mapInArrow(lambda b: _blocks(b, p), "u long, v long")
        edges = stash.put(edges.union(joins.distinct()))
        label = components(edges, stash)
    joined = member.join(label, member.rep == label.node, "left")
    component = F.coalesce("component", "rep")
    out = joined.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    if again is None:
        return out
    out = stash.put(out)
    more = out.join(_few(again, p.broadcast_ids), "id").withColumn("copy", F.explode(F.expr("sequence(2L, rows)")))
    return out.unionByName(more.select(*out.columns))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the smallest id."""
    p, stash = Params(), Stash(spark)
    judged = stash.put(near_duplicates(docs, p=p, stash=stash))
    gone = judged.filter("NOT kept").select(F.col("id").alias("doc_id")).distinct()
    out = docs.join(_few(gone, p.broadcast_ids), "doc_id", "left_anti")
    again = stash.put(judged.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").select(F.col("id").alias("doc_id")))
    if not again.isEmpty():  # rows that repeat an id: the greatest text stays, as it was judged
        repeated = out.join(_few(again, p.broadcast_ids), "doc_id", "left_semi")
        first = repeated.groupBy("doc_id").agg(F.max_by(F.struct(*own(docs)), F.struct("text", F.to_json(F.struct(*own(docs))))).alias("row")).select("row.*")
        out = out.join(_few(again, p.broadcast_ids), "doc_id", "left_anti").unionByName(first)
    return out.select(*own(docs))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: four-word shingles, links at a similarity of 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), p=Params(words=4)).withColumnRenamed("id", "doc_id")


SQL_TEXT = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

QUERIES = {"op5_minhash": op5_minhash}
SQL = {"op5_minhash": SQL_TEXT}
