"""Redaction: key labels and the payloads of sensitive subsystems are blanked and marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wire import LIVE_SLOTS

#: Subsystems from this number on are sensitive.
SENSITIVE = 0xFF00


def sensitive(subsystem: Column) -> Column:
    return subsystem >= SENSITIVE


def _blank(records: DataFrame, keys: Column) -> DataFrame:
    none = F.lit(bytearray())
    key, diag = F.col("keyref"), F.col("diag")
    return records.withColumn(
        "keyref", F.when(key.isNotNull() & keys, key.withField("label", none).withField("redacted", F.lit(True))).otherwise(key)
    ).withColumn("diag", F.when(diag.isNotNull() & sensitive(diag["subsystem"]), diag.withField("blob", none).withField("redacted", F.lit(True))).otherwise(diag))


def redact(records: DataFrame) -> DataFrame:
    """Every key label, and sensitive payloads."""
    return _blank(records, F.lit(True))


def redact_keystore(records: DataFrame, live: tuple = LIVE_SLOTS) -> DataFrame:
    """Labels of live key slots only, and sensitive payloads."""
    return _blank(records, F.col("keyref.slot_id").isin(*live) if live else F.lit(False))
