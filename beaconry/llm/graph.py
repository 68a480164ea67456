"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Every step is an aggregation and a join on one node, both of rows of two numbers; a hub is a skewed
join key that adaptive execution splits, because both sides are plain tables. Nothing is collected but
the count and checksum that show that the edges no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash


class Unsettled(RuntimeError):
    """An iteration that didn't end within its rounds: the result would be wrong, so there is none."""


def _large_star(edges: DataFrame, stash: Stash) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stash.put(both.groupBy("u").agg(F.min("v").alias("m")))
    hops = both.join(least, "u").filter("v > u").select(F.greatest("v", F.least("u", "m")).alias("u"), F.least("u", "m").alias("v"))
    out = stash.put(hops.filter("u > v").distinct())
    stash.forget(least)
    return out


def _small_star(edges: DataFrame, stash: Stash) -> DataFrame:
    least = stash.put(edges.groupBy("u").agg(F.min("v").alias("m")))
    hops = edges.join(least, "u")
    out = stash.put(hops.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct())
    stash.forget(least)
    return out


def components(edges: DataFrame, stash: Stash, most: int = 200) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns u > v) but each component's smallest.

    The steps run until they change nothing: about the logarithm of the longest path. ``Unsettled`` after ``most``.
    """
    edges = stash.put(edges)
    mark = None
    for _ in range(most):
        large = _large_star(edges, stash)
        after = _small_star(large, stash)
        stash.forget(edges, large)
        now = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        edges = after
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
    raise Unsettled(f"components still change after {most} rounds")
