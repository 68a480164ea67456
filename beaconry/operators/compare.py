"""Record equality, positional comparison of two streams and keep-first deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import KINDS, TAGS
from ..functions.text import float_text, until_nul


def _unequal(x: Column, y: Column) -> Column:
    return ~x.eqNullSafe(y)


def _floats_unequal(x: Column, y: Column) -> Column:
    """As in C: a NaN differs from everything, zeros are equal."""
    return F.isnan(x) | F.isnan(y) | (x != y)


def _why(a: str, b: str, ignore_redaction: bool) -> Column:
    """The first difference of the records ``a`` and ``b`` (struct columns) in the kinds' field order; null if none."""
    # The fields' order and names and the wording of the messages below.
    c = lambda side, path: F.col(f"{side}.{path}")

    def number(kind: str, field: str, get=lambda x: x) -> tuple[Column, Column]:
        x, y = get(c(a, f"{kind}.{field}")), get(c(b, f"{kind}.{field}"))
        label = {"samples": "count", "pairs": "pair_count"}.get(field, field)
        return _unequal(x, y), F.concat(F.lit(f"u.{kind}.{label} "), x.cast("string"), F.lit(" != "), y.cast("string"))

    def flag(kind: str) -> list:
        return [] if ignore_redaction else [number(kind, "redacted", lambda x: x.cast("int"))]

    def payload(kind: str, field: str, name: str) -> tuple[Column, Column]:
        x, y = c(a, f"{kind}.{field}"), c(b, f"{kind}.{field}")
        return _unequal(x, y), F.concat(F.lit(f"{name} differs ("), F.length(x).cast("string"), F.lit(" vs "), F.length(y).cast("string"), F.lit(" bytes)"))

    def text(kind: str, field: str, message: str) -> tuple[Column, Column]:
        return _unequal(until_nul(c(a, f"{kind}.{field}")), until_nul(c(b, f"{kind}.{field}"))), F.lit(message)

    x, y = c(a, "sensor.samples"), c(b, "sensor.samples")
    at = F.array_position(F.zip_with(x, y, _floats_unequal), True).cast("int")
    shown = [float_text(F.array(F.get(s, at - 1)), "%.9g")[0] for s in (x, y)]
    samples = (at > 0, F.concat(F.lit("sensor.samples["), (at - 1).cast("string"), F.lit("] "), shown[0], F.lit(" != "), shown[1]))
    cut = lambda p: F.concat(F.hex(until_nul(p["key"])), F.lit("="), F.hex(until_nul(p["value"])))
    pair = F.array_position(F.zip_with(c(a, "config.pairs"), c(b, "config.pairs"), lambda p, q: cut(p) != cut(q)), True)
    tests = {
        "heartbeat": [number("heartbeat", f) for f in ("uptime_s", "seq")],
        "sensor": [number("sensor", "sensor_id"), number("sensor", "samples", F.size), samples],
        "event": [number("event", "code"), payload("event", "payload", "event payload")],
        "diag": [number("diag", "subsystem"), *flag("diag"), payload("diag", "blob", "diag blob")],
        "geo": [number("geo", f) for f in ("lat_e7", "lon_e7", "alt_mm")],
        "battery": [number("battery", f) for f in ("pct", "temp_c_e1", "cycles")],
        "net": [number("net", f) for f in ("iface_id", "rx_bytes", "tx_bytes", "rx_pkts", "tx_pkts")],
        "log": [number("log", "severity"), text("log", "msg", "log message differs")],
        "config": [number("config", "pairs", F.size), (pair > 0, F.concat(F.lit("config pair "), (pair - 1).cast("string"), F.lit(" differs")))],
        "keyref": [number("keyref", "slot_id"), *flag("keyref"), *([] if ignore_redaction else [text("keyref", "label", "keyref label differs")])],
        "firmware": [*[number("firmware", f) for f in ("major", "minor", "patch")], (_unequal(c(a, "firmware.hash"), c(b, "firmware.hash")), F.lit("firmware hash differs"))],
    }
    out = F.lit(None).cast("string")
    for kind, rules in tests.items():
        first = F.lit(None).cast("string")
        for differs, message in reversed(rules):
            first = F.when(differs, message).otherwise(first)
        out = F.when(c(a, "tag") == TAGS[kind.upper()], first).otherwise(out)
    tags = F.concat(F.lit("tag "), c(a, "type"), F.lit(" != "), c(b, "type"))
    return F.substring(F.when(c(a, "tag") != c(b, "tag"), tags).otherwise(out), 1, 95)


_BODY = ["tag", "type", *KINDS]


def diff(left: DataFrame, right: DataFrame, ignore_redaction: bool = False, on=("record_index",), left_name="a", right_name="b") -> DataFrame:
    """``record_index, why`` for every pair that differs and every record on one side only."""
    a = left.select(*on, F.struct(*_BODY).alias("a"))
    b = right.select(*on, F.struct(*_BODY).alias("b"))
    only = lambda name, side: F.concat(F.lit(f"only in {name} (tag "), F.col(f"{side}.type"), F.lit(")"))
    why = F.when(F.col("b").isNull(), only(left_name, "a")).when(F.col("a").isNull(), only(right_name, "b")).otherwise(_why("a", "b", ignore_redaction))
    return a.join(b, list(on), "full_outer").select(*on, why.alias("why")).filter("why IS NOT NULL")


def report(differences: DataFrame, max_report: int = 0) -> list[str]:
    """The printed lines, in order; ``max_report`` of them (0: all) and a line for the rest."""
    ordered = differences.orderBy("record_index")
    rows = (ordered.limit(max_report) if max_report else ordered).collect()
    out = [f"record {r['record_index']}: {r['why']}" for r in rows]
    rest = differences.count() - len(rows) if max_report else 0
    return out + ([f"... {rest} more differences suppressed"] if rest else [])


def records_equal(left: DataFrame, right: DataFrame, ignore_redaction: bool = False, on=("record_index",), missing: bool = False) -> DataFrame:
    """``on..., equal`` for each pair; with ``missing`` also for records on one side only, which equal nothing."""
    a, b = (d.select(*on, F.struct(*_BODY).alias(n)) for d, n in ((left, "a"), (right, "b")))
    equal = _why("a", "b", ignore_redaction).isNull()
    if missing:
        equal = F.col("a").isNotNull() & F.col("b").isNotNull() & equal
    return a.join(b, list(on), "full_outer" if missing else "inner").select(*on, equal.alias("equal"))


def identity() -> Column:
    """What makes two records duplicates, as a struct: the record without its coordinates, key labels and marks.

    A sensor record with a NaN equals nothing, so its place is part of its identity.
    """
    nan = F.exists(F.coalesce(F.col("sensor.samples"), F.array().cast("array<float>")), F.isnan)
    cut = F.transform("config.pairs", lambda p: F.struct(until_nul(p["key"]).alias("key"), until_nul(p["value"]).alias("value")))
    return F.struct(
        "tag", "heartbeat", F.struct("sensor.sensor_id", F.transform("sensor.samples", lambda x: x + F.lit(0.0).cast("float")).alias("samples")).alias("sensor"), "event",
        F.struct("diag.subsystem", "diag.blob").alias("diag"), "geo", "battery", "net", F.struct(F.col("log.severity"), until_nul(F.col("log.msg")).alias("msg")).alias("log"),
        cut.alias("config"), F.col("keyref.slot_id").alias("slot"), "firmware", F.when(nan, F.struct("path", "record_index")).alias("alone"),
    )


def dedup(records: DataFrame, key: Column | None = None, order=("path", "record_index"), stream=()) -> DataFrame:
    """The first record of each identity within ``stream`` (all records by default).

    The first place of each identity is a minimum, which aggregates before the shuffle, so a heavily
    repeated record is no hot task; the records then meet their first places in a join.
    """
    place = F.struct(*order)
    # two 64-bit hashes with different seeds stand for the identity: 128 bits
    identity_ = key if key is not None else identity()
    hashed = records.select(*stream, *order, F.struct(F.xxhash64(identity_).alias("a"), F.xxhash64(F.lit(1), identity_).alias("b")).alias("__h"))
    firsts = hashed.groupBy(*stream, "__h").agg(F.min(place).alias("__first")).select(F.col("__first").alias("__place"))
    return records.withColumn("__place", place).join(firsts, "__place", "left_semi").drop("__place")


def dropped(records: DataFrame, **how) -> DataFrame:
    """``dropped``: how many records ``dedup`` leaves out."""
    return records.agg(F.count(F.lit(1)).alias("n")).join(dedup(records, **how).agg(F.count(F.lit(1)).alias("k"))).select((F.col("n") - F.col("k")).alias("dropped"))
