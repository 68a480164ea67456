"""Best-fit packing of documents into sequences of several permitted lengths.

A document's length is its number of token ids, its end id included (see ``token_ids``). Documents longer than the largest
length are cut into pieces of it and a rest. Pieces are dealt by a hash into shards of bounded size, whose number grows
with the input, and each shard packs alone: pieces by falling length, each into the open bin that it fills best; where none has
room, a bin opens.

The lengths are optimised jointly under one cost: a sequence of c tokens costs ``overhead + c + c * c / attention`` (a long
sequence costs more per token, a short one wastes the overhead and the space that no piece fits). A bin opens at the length
with the least cost per token that it can hold: its own piece, and as much as the remaining pieces' lengths, largest first,
fill of the rest. Besides this policy a shard tries each permitted length as the least one to open, shrinks each bin to the
shortest length that holds its contents, and keeps the cheapest packing of all. So a shard never costs more than with any single length.

Defined results: a null or empty text is its end token; repeated rows are packed each; ties go by id, then
piece; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import token_ids
from .common import TEXT_ROWS, Stash


@dataclass(frozen=True)
class Params:
    lengths: tuple = (512, 1024, 2048, 4096, 8192)
    #: Cost of a bin besides its tokens, and the length at which a token costs twice as much.
    overhead: int = 32
    attention: int = 65_536
    shard_pieces: int = 50_000

    def cost(self, length: int) -> float:
        return self.overhead + length + length * length / self.attention


class _Remaining:
    """The lengths of the pieces that are still to come, as counts and a bit set."""

    def __init__(self, sizes: list[int]):
        self.counts = Counter(sizes)
        self.bits = 0
        for n in self.counts:
            self.bits |= 1 << n

    def take(self, n: int) -> None:
        self.counts[n] -= 1
        if not self.counts[n]:
            self.bits ^= 1 << n

    def fill(self, room: int) -> int:
        """Tokens of ``room`` that the remaining pieces can fill, the largest that fits first."""
        held, bits = 0, self.bits & (2 << room) - 1
        while bits:
            n = bits.bit_length() - 1
            held += n * min(self.counts[n], (room - held) // n)
            bits &= (1 << min(n, room - held + 1)) - 1
        return held


def _fit(sizes: list[int], p: Params, least: int | None) -> tuple[list[int], list[int], list[int]]:
    """Bins and offsets of the pieces, and the tokens in each bin. least: the shortest length to open; None: the least cost."""
    remaining, open_, rooms = _Remaining(sizes) if least is None else None, 0, {}
    bins, offsets, used, capacity = [], [], [], []
    for n in sizes:
        if remaining:
            remaining.take(n)
        fitting = open_ >> n << n  # bit r: a bin with r tokens of room is open
        if fitting:
            room = (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_ ^= 1 << room
        else:
            b = len(capacity)
            if remaining:
                c = min((c for c in p.lengths if c >= n), key=lambda c: (p.cost(c) / (n + remaining.fill(c - n)), c))
            else:
                c = min(c for c in p.lengths if c >= max(n, least))
            capacity.append(c), used.append(0)
        bins.append(b), offsets.append(used[b])
        used[b] += n
        room = capacity[b] - used[b]
        if room:
            rooms.setdefault(room, []).append(b)
            open_ |= 1 << room
    return bins, offsets, used


def pack(sizes: list[int], p: Params, policies: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in the bin and bin length of each piece (sizes at most the largest length, falling), by the cheapest policy."""
    best = None
    for least in policies or (None, *p.lengths):
        bins, offsets, used = _fit(sizes, p, least)
        final = [min(c for c in p.lengths if c >= u) for u in used]
        cost = sum(map(p.cost, final))
        if best is None or cost < best[0]:
            best = cost, bins, offsets, final
    bins = np.array(best[1], np.int64)
    return bins, np.array(best[2], np.int64), np.array(best[3], np.int64)[bins] if len(bins) else bins


def _pack_shard(frame: pd.DataFrame, p: Params) -> pd.DataFrame:
    f = frame.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable", na_position="first")
    bins, offsets, final = pack(f["length"].tolist(), p)
    return f.assign(bin_id=(f["shard"].to_numpy() << 32) | bins, offset=offsets, bin_length=final)[["id", "piece", "start", "length", "bin_id", "offset", "bin_length"]]


def best_fit(lengths: DataFrame, p: Params | None = None, stash: Stash | None = None) -> DataFrame:
    """``id, piece, start, length, bin_id, offset, bin_length`` for ``lengths`` (id long, n long)."""
    p = p or Params()
    top = max(p.lengths)
    stash = stash or Stash(lengths.sparkSession)
    n = stash.put(lengths.select("id", "n").filter("n > 0"), TEXT_ROWS)
    pieces = n.select("id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(top).cast("long"))).alias("piece", "start"))
    pieces = pieces.select("id", F.col("piece").cast("long").alias("piece"), "start", F.least(F.lit(top).cast("long"), F.col("n") - F.col("start")).alias("length"))
    count = n.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    shards = int(-(-count // p.shard_pieces)) or 1
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "length"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(lambda f: _pack_shard(f, p), "id long, piece long, start long, length long, bin_id long, offset long, bin_length long")


def pack_documents(docs: DataFrame, p: Params | None = None, tokens: token_ids.Params | None = None) -> DataFrame:
    """``doc_id, piece, start, length, bin_id, offset, bin_length``: where each document's ids go."""
    tokens = tokens or token_ids.Params(token_ids.public_vocabulary())
    return best_fit(token_ids.lengths(docs, tokens), p).withColumnRenamed("id", "doc_id")


def sequences(docs: DataFrame, packed: DataFrame, p: Params | None = None, tokens: token_ids.Params | None = None) -> DataFrame:
    """``bin_id, bin_length, ids``: the packed sequences themselves. Ids of documents must not repeat."""
    p, tokens = p or Params(), tokens or token_ids.Params(token_ids.public_vocabulary())
    top = max(p.lengths)
    ids = token_ids.encoded(docs, tokens)
    pieces = ids.select("id", F.posexplode(F.expr(f"transform(sequence(0, size(ids) - 1, {top}), i -> slice(ids, i + 1, {top}))")).alias("piece", "ids"))
    placed = packed.select(F.col("doc_id").alias("id"), F.col("piece").cast("int").alias("piece"), "bin_id", "bin_length", "offset")
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a bin is bounded
    return pieces.join(placed, ["id", "piece"]).groupBy("bin_id", "bin_length").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in bins."""
    return pack_documents(docs)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_packing": op9_packing}
SQL: dict[str, str] = {}
