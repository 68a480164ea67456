"""Statistics over records: counts, seventeen numeric summaries, the severity histogram and the tag index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Label and value of each summary; sensor.value takes every sample, the others one value per record.
SUMMARIES: dict[str, str] = {
    "hb.uptime_s": "heartbeat.uptime_s", "hb.seq": "heartbeat.seq", "battery.pct": "battery.pct", "battery.cycles": "battery.cycles",
    "geo.lat_e7": "geo.lat_e7", "geo.lon_e7": "geo.lon_e7", "geo.alt_mm": "geo.alt_mm", "net.rx_bytes": "net.rx_bytes", "net.tx_bytes": "net.tx_bytes",
    "net.rx_pkts": "net.rx_pkts", "net.tx_pkts": "net.tx_pkts", "sensor.samples": "if(sensor is null, null, size(sensor.samples))", "sensor.value": "sensor.samples",
    "event.code": "event.code", "event.payload_len": "length(event.payload)", "diag.blob_len": "length(diag.blob)", "config.pairs": "if(config is null, null, size(config.pairs))",
}


def _parts(label: str) -> str:
    """SQL of one summary's struct; a record's samples are folded before the aggregation, without an explode."""
    v = f"cast({SUMMARIES[label]} as double)"
    n, low, high, total = f"count({v})", f"min({v})", f"max({v})", f"sum({v})"
    if label == "sensor.value":
        s = SUMMARIES[label]
        n, low, high = f"coalesce(sum(cast(size({s}) as bigint)), 0L)", f"cast(min(array_min({s})) as double)", f"cast(max(array_max({s})) as double)"
        total = f"sum(if(size({s}) > 0, aggregate({s}, 0D, (a, x) -> a + cast(x as double)), null))"
    return f"named_struct('label', '{label}', 'n', {n}, 'min', {low}, 'max', {high}, 'sum', {total})"


def numeric(records: DataFrame) -> DataFrame:
    """``label, n, min, max, avg, sum`` of every summary with values: one pass, one row per task shuffled."""
    wide = records.agg(F.expr(f"array({', '.join(map(_parts, SUMMARIES))})").alias("rows"))
    return wide.selectExpr("inline(rows)").filter("n > 0").selectExpr("label", "n", "min", "max", "sum / n as avg", "sum")


def by_type(records: DataFrame) -> DataFrame:
    return records.groupBy("tag", "type").agg(F.count(F.lit(1)).alias("records"))


def severities(records: DataFrame) -> DataFrame:
    return records.filter("log IS NOT NULL").groupBy(F.col("log.severity").alias("severity")).agg(F.count(F.lit(1)).alias("records"))


def redaction_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(F.coalesce("keyref.redacted", F.lit(False))).alias("keyref_redacted"), F.count_if(F.coalesce("diag.redacted", F.lit(False))).alias("diag_redacted"))


def totals(records: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """``records, parse_errors``."""
    good = records.select(F.lit(0).alias("bad"))
    both = good if errors is None else good.union(errors.select(F.lit(1)))
    return both.agg(F.count_if(F.col("bad") == 0).alias("records"), F.count_if(F.col("bad") == 1).alias("parse_errors"))


def postings(records: DataFrame) -> DataFrame:
    """The tag index: where each record is."""
    return records.select("path", "tag", "section_index", "record_in_sec", "record_index")


def write_index(records: DataFrame, path: str) -> None:
    """The index as Parquet, one folder per tag, so that a lookup reads its tag only."""
    postings(records).write.partitionBy("tag").parquet(path)


def lookup(index: DataFrame, tag: int) -> DataFrame:
    """Entries of one tag; the order of the build is (path, record_index)."""
    return index.filter(F.col("tag") == tag)
