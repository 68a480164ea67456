"""Record text: CSV and JSON rows, the printed line, and the small formats they use.

All columns are built-in expressions but the C-style ``%g`` of float samples, an Arrow UDF that sees the
sample arrays only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .schema import TAGS, TelemetryError

CSV_HEADER = "index,tag,f0,f1,f2,f3,f4,f5"
FORMATS = ("csv", "json")


def parse_format(name: str) -> str:
    if name not in FORMATS:
        raise TelemetryError("INVAL", name)
    return name


def until_nul(b: Column) -> Column:
    """A byte string up to its first NUL."""
    nul = F.locate("\0", F.decode(b, "ISO-8859-1"))
    return F.when(nul > 0, F.substring(b, F.lit(1), nul - 1)).otherwise(b)


def hex_text(b: Column) -> Column:
    return F.lower(F.hex(b))


def hex_bytes(s: Column) -> Column:
    """Strict: null for odd lengths and other characters."""
    return F.when(F.length(s) % 2 == 0, F.unhex(s))


def version_parts(s: Column) -> list[Column]:
    """The three numbers of "a.b.c", null where it isn't one."""
    return [F.when(s.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), F.split(s, r"\.")[i]).try_cast("int") for i in range(3)]


def float_text(samples: Column, form: str) -> Column:
    """Each sample in a C format such as ``%.9g``."""

    @F.pandas_udf("array<string>")
    def format_samples(s: pd.Series) -> pd.Series:
        def one(x):
            y = form % x
            return {"inf": "inf", "-inf": "-inf", "nan": "nan"}.get(y, y)

        return s.map(lambda v: None if v is None else [one(float(x)) for x in v])

    return format_samples(samples)


def _text(b: Column) -> Column:
    return F.decode(b, "UTF-8")


def csv_string(b: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(_text(b), F.lit('"'), F.lit('""')), F.lit('"'))


def json_string(b: Column) -> Column:
    s = _text(b)
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(plain), F.lit(escaped))
    rare = s
    for c in range(0x20):
        if c not in (9, 10, 13):
            rare = F.replace(rare, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    return F.concat(F.lit('"'), F.when(s.rlike(r"[\x00-\x1f]"), rare).otherwise(s), F.lit('"'))


def _n(c: str) -> Column:
    return F.col(c).cast("string")


def _flag(c: str) -> Column:
    return F.when(F.col(c), "1").otherwise("0")


def _row(parts: dict[str, list], sep: str = "") -> Column:
    out = F.lit(None).cast("string")
    for kind, pieces in parts.items():
        out = F.when(F.col("tag") == TAGS[kind.upper()], F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])).otherwise(out)
    return out


def _joined(kind_fields: dict[str, str]) -> list:
    """``,"name":value`` for each field."""
    out: list = []
    for name, column in kind_fields.items():
        out += [f',"{name}":', _n(column)]
    return out


def csv_row(index: Column) -> Column:
    """One line of the CSV export; lines of different kinds differ in their number of fields."""
    commas = lambda *c: [x for i, f in enumerate(c) for x in ([",", f] if i else [f])]
    pairs = F.slice("config.pairs", 1, 2)
    kinds = {
        "heartbeat": [*commas(_n("heartbeat.uptime_s"), _n("heartbeat.seq")), ",,,,"],
        "sensor": [*commas(_n("sensor.sensor_id"), F.size("sensor.samples").cast("string")), F.array_join(F.transform(float_text(F.slice("sensor.samples", 1, 4), "%.6g"), lambda x: F.concat(F.lit(","), x)), "")],
        "event": [*commas(_n("event.code"), F.length("event.payload").cast("string"), hex_text(F.col("event.payload"))), ",,"],
        "diag": [*commas(_n("diag.subsystem"), F.length("diag.blob").cast("string"), _flag("diag.redacted"), F.when(F.col("diag.redacted"), "").otherwise(hex_text(F.col("diag.blob")))), ",,"],
        "geo": [*commas(_n("geo.lat_e7"), _n("geo.lon_e7"), _n("geo.alt_mm")), ",,,"],
        "battery": [*commas(_n("battery.pct"), _n("battery.temp_c_e1"), _n("battery.cycles")), ",,,"],
        "net": [*commas(*[_n(f"net.{f}") for f in ("iface_id", "rx_bytes", "tx_bytes", "rx_pkts", "tx_pkts")]), ","],
        "log": [_n("log.severity"), ",", csv_string(F.col("log.msg")), ",,,"],
        "config": [F.size("config.pairs").cast("string"), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit(","), csv_string(until_nul(p["key"])), F.lit(","), csv_string(until_nul(p["value"])))), "")],
        "keyref": [_n("keyref.slot_id"), ",", _flag("keyref.redacted"), ",", csv_string(F.when(F.col("keyref.redacted"), F.lit(bytearray())).otherwise(F.col("keyref.label"))), ",,,"],
        "firmware": [*commas(_n("firmware.major"), _n("firmware.minor"), _n("firmware.patch"), hex_text(F.col("firmware.hash"))), ",,"],
    }
    return F.concat(index.cast("string"), F.lit(","), F.col("type"), F.lit(","), _row(kinds))


def json_row(index: Column) -> Column:
    """One object of the JSON export."""
    flag = lambda c: F.when(F.col(c), "true").otherwise("false")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    pairs = F.array_join(F.transform("config.pairs", lambda p: F.concat(json_string(until_nul(p["key"])), F.lit(":"), json_string(until_nul(p["value"])))), ",")
    plain = {k: _joined({f: f"{k}.{f}" for f in fs}) for k, fs in {
        "heartbeat": ("uptime_s", "seq"), "geo": ("lat_e7", "lon_e7", "alt_mm"), "battery": ("pct", "temp_c_e1", "cycles"), "net": ("iface_id", "rx_bytes", "tx_bytes", "rx_pkts", "tx_pkts"),
    }.items()}
    kinds = plain | {
        "sensor": [*_joined({"sensor_id": "sensor.sensor_id"}), ',"samples":[', F.array_join(float_text(F.col("sensor.samples"), "%.9g"), ","), "]"],
        "event": [*_joined({"code": "event.code"}), ',"payload_hex":', quoted(hex_text(F.col("event.payload")))],
        "diag": [*_joined({"subsystem": "diag.subsystem"}), ',"redacted":', flag("diag.redacted"), ',"blob_hex":', quoted(F.when(F.col("diag.redacted"), "").otherwise(hex_text(F.col("diag.blob"))))],
        "log": [*_joined({"severity": "log.severity"}), ',"msg":', json_string(F.col("log.msg"))],
        "config": [',"pairs":{', pairs, "}"],
        "keyref": [*_joined({"slot_id": "keyref.slot_id"}), ',"redacted":', flag("keyref.redacted"), ',"label":', json_string(F.when(F.col("keyref.redacted"), F.lit(bytearray())).otherwise(F.col("keyref.label")))],
        "firmware": [',"version":', quoted(F.concat_ws(".", "firmware.major", "firmware.minor", "firmware.patch")), ',"hash_hex":', quoted(hex_text(F.col("firmware.hash")))],
    }
    return F.concat(F.lit('{"index":'), index.cast("string"), F.lit(',"tag":'), F.col("tag").cast("string"), F.lit(',"type":"'), F.col("type"), F.lit('"'), _row(kinds), F.lit("}"))


def interface_class(iface: Column) -> Column:
    return F.when(iface >= 128, "ext").otherwise("int")


def printed(index: Column) -> Column:
    """The line that the decode and query tools print."""
    named = lambda kind, *fs: [x for f in fs for x in (f" {f}=", _n(f"{kind}.{f}"))]
    kinds = {
        "heartbeat": named("heartbeat", "uptime_s", "seq"), "geo": named("geo", "lat_e7", "lon_e7", "alt_mm"), "battery": named("battery", "pct", "temp_c_e1", "cycles"),
        "net": [*named("net", "iface_id"), "/", interface_class(F.col("net.iface_id")), *named("net", "rx_bytes", "tx_bytes", "rx_pkts", "tx_pkts")],
        "firmware": [*named("firmware", "major", "minor", "patch"), " hash=", hex_text(F.col("firmware.hash"))],
        "sensor": [*named("sensor", "sensor_id"), " count=", F.size("sensor.samples").cast("string"), " samples=", F.array_join(float_text(F.col("sensor.samples"), "%g"), ",")],
        "event": [*named("event", "code"), " payload_len=", F.length("event.payload").cast("string"), " payload=", hex_text(F.col("event.payload"))],
        "log": [*named("log", "severity"), " msg_len=", F.length("log.msg").cast("string"), ' msg="', _text(F.col("log.msg")), '"'],
        "config": [" pair_count=", F.size("config.pairs").cast("string"), F.array_join(F.transform("config.pairs", lambda p: F.concat(F.lit(" "), _text(until_nul(p["key"])), F.lit("="), _text(until_nul(p["value"])))), "")],
        "keyref": [*named("keyref", "slot_id"), " label_len=", F.length("keyref.label").cast("string"), ' label="', _text(F.col("keyref.label")), '" redacted=', _flag("keyref.redacted")],
        "diag": [F.format_string(" subsystem=0x%04x", F.col("diag.subsystem")), " blob_len=", F.length("diag.blob").cast("string"), " blob=", hex_text(F.col("diag.blob")), " redacted=", _flag("diag.redacted")],
    }
    return F.concat(index.cast("string"), F.lit(" "), F.col("type"), _row(kinds))


def hexdump(data: bytes) -> str:
    """Sixteen bytes a line with offset and printable characters."""
    lines = []
    for at in range(0, len(data), 16):
        part = data[at : at + 16]
        halves = "  ".join(" ".join(f"{b:02x}" for b in h).ljust(23) for h in (part[:8], part[8:]))
        lines.append(f"{at:08x}  {halves}  |{''.join(chr(b) if 32 <= b < 127 else '.' for b in part)}|")
    return "\n".join(lines)
