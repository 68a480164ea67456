"""Validation rules: every record against its kind's rules, in one pass without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import ERRORS, NAMES


def _rules() -> list[tuple[str, str, Column, Column]]:
    """Rule, severity, when it holds, message; a missing kind makes the condition null."""
    # The rules' severities and messages.
    c, t = F.col, F.lit
    empty = lambda b: F.length(b) == 0
    text = lambda fmt, *a: F.format_string(fmt, *a)
    return [
        ("VAL-1", "warning", c("heartbeat.seq") == 0, t("heartbeat with seq 0")),
        ("VAL-2", "info", c("sensor").isNotNull() & (F.size("sensor.samples") == 0), t("sensor record with no samples")),
        ("VAL-3", "warning", empty(c("event.payload")), text("event 0x%04x with empty payload", c("event.code"))),
        ("VAL-4", "warning", empty(c("diag.blob")) & ~c("diag.redacted"), text("diag subsystem %d with empty blob", c("diag.subsystem"))),
        ("VAL-5", "error", F.abs(c("geo.lat_e7").cast("long")) > 900000000, text("latitude %d out of range", c("geo.lat_e7"))),
        ("VAL-6", "error", F.abs(c("geo.lon_e7").cast("long")) > 1800000000, text("longitude %d out of range", c("geo.lon_e7"))),
        ("VAL-7", "error", c("battery.pct") > 100, text("battery pct %d over 100", c("battery.pct"))),
        ("VAL-8", "warning", (c("net.rx_pkts") == 0) & (c("net.rx_bytes") != 0), t("rx_bytes nonzero with zero rx_pkts")),
        ("VAL-9", "warning", (c("net.tx_pkts") == 0) & (c("net.tx_bytes") != 0), t("tx_bytes nonzero with zero tx_pkts")),
        ("VAL-10", "warning", c("log.severity") > 7, text("log severity %d above syslog range", c("log.severity"))),
        ("VAL-11", "info", empty(c("log.msg")), t("empty log message")),
        ("VAL-13", "warning", c("keyref.slot_id") == 0, t("keyref references reserved slot 0")),
        ("VAL-14", "warning", (c("firmware.major") == 0) & (c("firmware.minor") == 0) & (c("firmware.patch") == 0), t("firmware version 0.0.0")),
        ("VAL-15", "error", ~c("tag").isin(*NAMES), text("unknown record tag 0x%02x", c("tag"))),
    ]


def _issue(rule: str, severity: str, message: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))


def issues(records: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """``path, section_index, record_in_sec, record_index, rule, severity, message``: a row per issue.

    ``errors`` are the reader's: faults within a container, and containers that were rejected (no section).
    """
    found = F.array(*[F.when(F.coalesce(holds, F.lit(False)), _issue(r, s, m)) for r, s, holds, m in _rules()])
    pairs = F.coalesce(F.transform("config.pairs", lambda p, i: F.when(F.coalesce(F.length(p["key"]), F.lit(0)) == 0, _issue("VAL-12", "error", F.format_string("config pair %d has empty key", i)))), F.array())
    each = F.filter(F.concat(found, pairs), lambda x: x.isNotNull())
    at = ["path", "section_index", "record_in_sec", "record_index"]
    out = records.select(*at, F.explode(each).alias("x")).select(*at, "x.rule", "x.severity", "x.message")
    if errors is None:
        return out
    text = F.coalesce(*[F.when(F.col("error") == k, v) for k, v in ERRORS.items()], F.lit("unknown error"))
    whole = F.col("section_index").isNull()
    message = F.concat(F.when(whole, "container rejected: ").otherwise("decode/parse failure: "), text)
    zero = F.lit(0).cast("long")
    bad = errors.select("path", F.coalesce("section_index", F.lit(0)).alias("section_index"), F.coalesce("record_in_sec", zero).alias("record_in_sec"), F.lit(None).cast("long").alias("record_index"), F.when(whole, "VAL-17").otherwise("VAL-16").alias("rule"), F.lit("error").alias("severity"), message.alias("message"))
    return out.unionByName(bad)


def summary(records: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """``records, errors, warnings, verdict`` over all records."""
    marks = issues(records, errors).select(F.lit(0).alias("r"), F.col("severity").alias("s"))
    both = records.select(F.lit(1).alias("r"), F.lit(None).cast("string").alias("s")).unionAll(marks)
    out = both.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("records"), F.count_if(F.col("s") == "error").alias("errors"), F.count_if(F.col("s") == "warning").alias("warnings"))
    return out.withColumn("verdict", F.when(F.col("errors") > 0, "FAIL").otherwise("OK"))


def report(records: DataFrame, errors: DataFrame | None = None) -> list[str]:
    """The printed report of one container."""
    rows = issues(records, errors).orderBy("section_index", "record_in_sec", "rule").collect()
    t = summary(records, errors).first()
    lines = [f"{r['severity']:<7s} section={r['section_index']} record={r['record_in_sec']} {r['message']}" for r in rows]
    return lines + [f"validate: records={t['records']} errors={t['errors']} warnings={t['warnings']} -> {t['verdict']}"]
