"""The record model: eleven kinds, one nullable struct per kind beside the record's coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag numbers and names.
TAGS = {
    "HEARTBEAT": 0x10, "SENSOR": 0x11, "EVENT": 0x12, "DIAG": 0x13, "GEO": 0x14, "BATTERY": 0x15,
    "NET": 0x16, "LOG": 0x17, "CONFIG": 0x18, "KEYREF": 0x19, "FIRMWARE": 0x1A,
}
NAMES = {v: k for k, v in TAGS.items()}

#: Kind to its struct, as Spark DDL.
KINDS = {
    "heartbeat": "struct<uptime_s:bigint,seq:bigint>",
    "sensor": "struct<sensor_id:int,samples:array<float>>",
    "event": "struct<code:int,payload:binary>",
    "diag": "struct<subsystem:int,blob:binary,redacted:boolean>",
    "geo": "struct<lat_e7:int,lon_e7:int,alt_mm:int>",
    "battery": "struct<pct:smallint,temp_c_e1:smallint,cycles:bigint>",
    "net": "struct<iface_id:smallint,rx_bytes:bigint,tx_bytes:bigint,rx_pkts:bigint,tx_pkts:bigint>",
    "log": "struct<severity:smallint,msg:binary>",
    "config": "struct<pairs:array<struct<key:binary,value:binary>>>",
    "keyref": "struct<slot_id:smallint,label:binary,redacted:boolean>",
    "firmware": "struct<major:int,minor:int,patch:int,hash:binary>",
}
COORDINATES = "path string, section_index int, section_type int, codec_id smallint, record_in_sec bigint, record_index bigint"
RECORD_DDL = f"{COORDINATES}, tag smallint, type string, " + ", ".join(f"{k} {v}" for k, v in KINDS.items())
ERROR_DDL = "path string, section_index int, record_in_sec bigint, error string, fatal boolean"

# Error codes and their texts.
ERRORS = {
    "OK": "success", "TRUNCATED": "input truncated", "BADMAGIC": "bad magic", "BADVERSION": "unsupported version",
    "BADHEADER": "malformed header", "BADRECORD": "malformed record", "RANGE": "value out of range", "OOM": "out of memory",
    "INVAL": "invalid argument", "IO": "i/o error", "BADQUERY": "malformed query",
}


class TelemetryError(ValueError):
    """An error with one of the codes of ERRORS."""

    def __init__(self, code: str, detail: str = ""):
        self.code = code
        super().__init__(ERRORS[code] + (f": {detail}" if detail else ""))


def strerror(code: str) -> str:
    return ERRORS.get(code, "unknown error")


def tag_name(tag: Column) -> Column:
    out = F.lit("UNKNOWN")
    for name, value in TAGS.items():
        out = F.when(tag == value, name).otherwise(out)
    return out


def name_tag(name: Column, fold_case: bool = False) -> Column:
    """The tag of a kind's name, null for none; the query language folds case, imports don't."""
    given = F.upper(name) if fold_case else name
    out = F.lit(None).cast("smallint")
    for n, value in TAGS.items():
        out = F.when(given == n, F.lit(value).cast("smallint")).otherwise(out)
    return out


def empty_kind(kind: str) -> Column:
    return F.lit(None).cast(KINDS[kind])
