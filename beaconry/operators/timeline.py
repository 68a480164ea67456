"""Sessions by heartbeat: each heartbeat opens one, later records belong to it until the next.

``stream`` names the columns that tell streams apart (files, devices). A stream's order is cut into ranges of
``RANGE`` ordinals: heartbeats are counted per range, the ranges' counts are summed up in order (one row per range),
and only the running count inside a range needs a sorted task. So a single long stream runs in many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import NAMES, TAGS

EXPECTED_S, TOLERANCE = 60, 2
#: Ordinals, and sessions, of one stream that one sorted task handles at a time.
RANGE = 1 << 20


def attributed(records: DataFrame, stream=("path",), order="record_index", span: int = RANGE) -> DataFrame:
    """``records`` with ``session`` (from 0; null before the first heartbeat)."""
    beat, part = (F.col("tag") == TAGS["HEARTBEAT"]).cast("long"), F.expr(f"`{order}` div {span}").alias("__range")
    counts = records.groupBy(*stream, part).agg(F.sum(beat).alias("__beats"))
    earlier = Window.partitionBy(*stream).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(c).alias(f"__{c}") for c in stream], F.col("__range").alias("__of"), F.coalesce(F.sum("__beats").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*stream, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("__range") == F.col("__of")
    for c in stream:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    number = F.col("__inside") + F.col("__before")
    run = records.withColumn("__range", part).withColumn("__inside", F.sum(beat).over(inside)).join(before, same)
    return run.select(*records.columns, F.when(number > 0, number - 1).alias("session"))


def _followed(found: DataFrame, stream, span: int) -> DataFrame:
    """``found`` with the uptime of the session before: the last session of a range is shown to the next range too."""
    own = F.expr(f"session div {span}")
    shown = found.withColumn("__range", F.explode(F.when(F.col("session") % span == span - 1, F.array(own, own + 1)).otherwise(F.array(own))))
    before = F.lag("uptime_s").over(Window.partitionBy(*stream, "__range").orderBy("session"))
    return shown.withColumn("__before", before).filter(F.col("__range") == own).drop("__range")


def sessions(records: DataFrame, stream=("path",), order="record_index", expected_s: int = 0, tolerance: int = 0, span: int = RANGE) -> DataFrame:
    """One row per session: its heartbeat, counts, first record, and how it follows the session before.

    ``status`` is ORDERING where the uptime fell, GAP where it rose by more than tolerance * expected_s.
    """
    expected_s, tolerance = expected_s or EXPECTED_S, tolerance or TOLERANCE
    counts = [F.count_if(F.col("tag") == t).alias(f"n_{n.lower()}") for t, n in NAMES.items()]
    found = attributed(records.select(*stream, order, "tag", "heartbeat"), stream, order, span).filter("session IS NOT NULL").groupBy(*stream, "session").agg(
        F.max("heartbeat.uptime_s").alias("uptime_s"), F.max("heartbeat.seq").alias("seq"), F.count(F.lit(1)).alias("record_count"), F.min(order).alias("first_record_index"), *counts
    )
    delta = F.col("uptime_s") - F.col("__before")
    status = F.when(delta < 0, "ORDERING").when(delta > tolerance * expected_s, "GAP")
    return _followed(found, stream, span).withColumn("delta_s", delta).withColumn("status", status).drop("__before")


def summary(records: DataFrame, stream=("path",), order="record_index", expected_s: int = 0, tolerance: int = 0) -> DataFrame:
    """Sessions, gaps, ordering violations and unattributed records of each stream."""
    s = sessions(records, stream, order, expected_s, tolerance)
    per = s.groupBy(*stream).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("status") == "GAP").alias("gaps"), F.count_if(F.col("status") == "ORDERING").alias("ordering_violations"), F.sum("record_count").alias("in_sessions"))
    every = records.groupBy(*stream).agg(F.count(F.lit(1)).alias("records"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(per, list(stream), "left").select(*stream, z("sessions"), z("gaps"), z("ordering_violations"), (F.col("records") - F.coalesce("in_sessions", F.lit(0))).alias("unattributed"))


def report(records: DataFrame, expected_s: int = 0, tolerance: int = 0) -> list[str]:
    """The printed timeline of one stream (a driver-side report of one line per session)."""
    expected_s, tolerance = expected_s or EXPECTED_S, tolerance or TOLERANCE
    rows = sessions(records, expected_s=expected_s, tolerance=tolerance).orderBy("session").collect()
    total = summary(records, expected_s=expected_s, tolerance=tolerance).first()
    out = [f"sessions: {len(rows)} (heartbeat interval {expected_s}s, gap tolerance {tolerance}x)"]
    for r in rows:
        tags = ",".join(f"{n}:{r['n_' + n.lower()]}" for _, n in sorted(NAMES.items()) if r["n_" + n.lower()])
        out.append(f"  [{r['session']:3d}] uptime={r['uptime_s']:<10d}s seq={r['seq']:<8d} records={r['record_count']:<4d} tags={tags}")
        if r["status"] == "ORDERING":
            out.append(f"        ORDERING: uptime decreased ({r['uptime_s'] - r['delta_s']} -> {r['uptime_s']})")
        elif r["status"] == "GAP":
            out.append(f"        GAP: {r['delta_s']}s since previous heartbeat")
    if total and total["unattributed"]:
        out.append(f"unattributed-records (before first heartbeat): {total['unattributed']}")
    out.append(f"timeline: gaps={total['gaps'] if total else 0} ordering-violations={total['ordering_violations'] if total else 0}")
    return out
