"""Records of the report fixtures: eleven kinds as functions of a seed."""

from beaconry.functions.schema import NAMES, RECORD_DDL
from beaconry.functions import wire


def make_records(s: int) -> list[dict]:
    return [
        {"tag": 0x10, "heartbeat": {"uptime_s": 1000 * s + 1, "seq": 150 + 7 * s}},
        {"tag": 0x14, "geo": {"lat_e7": 100 * s, "lon_e7": -100 * s, "alt_mm": s}},
        {"tag": 0x15, "battery": {"pct": s % 100, "temp_c_e1": s - 55, "cycles": 3 * s}},
        {"tag": 0x16, "net": {"iface_id": s, "rx_bytes": 1000 * s, "tx_bytes": 500 * s, "rx_pkts": 8 * s, "tx_pkts": 4 * s}},
        {"tag": 0x1A, "firmware": {"major": s, "minor": s + 1, "patch": s + 2, "hash": bytes(range(s, s + 8))}},
        {"tag": 0x11, "sensor": {"sensor_id": s, "samples": [1.5 * s, -2.25, 3.0 + s]}},
        {"tag": 0x12, "event": {"code": 7 * s, "payload": bytes(range(s, s + 5))}},
        {"tag": 0x17, "log": {"severity": s % 8, "msg": b"smoke-log"}},
        {"tag": 0x18, "config": {"pairs": [{"key": b"mode", "value": b"fast" if s % 2 == 0 else b"slow"}, {"key": b"ver", "value": b"1.0"}]}},
        {"tag": 0x19, "keyref": {"slot_id": s % 8, "label": b"smoke-key", "redacted": False}},
        {"tag": 0x13, "diag": {"subsystem": 0x42, "blob": bytes(range(0xC0 + s, 0xC4 + s)), "redacted": False}},
    ]


#: The CLI fixture: sections of (type, codec, records).
CLI = [
    (1, 0, [{"tag": 0x10, "heartbeat": {"uptime_s": 1200, "seq": 5}}, {"tag": 0x10, "heartbeat": {"uptime_s": 99, "seq": 2}}, {"tag": 0x14, "geo": {"lat_e7": 374220000, "lon_e7": -1220841000, "alt_mm": 1500}}]),
    (2, 3, [{"tag": 0x19, "keyref": {"slot_id": 2, "label": b"supersecret"}}, {"tag": 0x13, "diag": {"subsystem": 0xFF00, "blob": b"\xab" * 8}}, {"tag": 0x13, "diag": {"subsystem": 0x42, "blob": bytes.fromhex("deadbeef")}}]),
    (3, 4, [{"tag": 0x17, "log": {"severity": 5, "msg": b"hello world"}}, {"tag": 0x15, "battery": {"pct": 15, "temp_c_e1": 210, "cycles": 99}}, {"tag": 0x18, "config": {"pairs": [{"key": b"mode", "value": b"fast"}]}}]),
]


def section(records: list[dict]) -> bytes:
    return b"".join(wire.frame(r["tag"], wire.pack_payload(r)) for r in records)


def container(sections, key=None) -> bytes:
    return wire.build_container([(t, c, section(r)) for t, c, r in sections], key)


def report_container(*seeds: int) -> bytes:
    return container([(1 + k, k % 2, make_records(s)) for k, s in enumerate(seeds)])


def frame(spark, records: list[dict], path="t"):
    rows = [{"path": path, "section_index": 0, "section_type": 1, "codec_id": 0, "record_in_sec": i, "record_index": i, "type": NAMES.get(r["tag"], "UNKNOWN"), **r} for i, r in enumerate(records)]
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES_IN_ORDER) for r in rows], RECORD_DDL)


NAMES_IN_ORDER = [x.strip().split(" ")[0] for x in ("path string, section_index int, section_type int, codec_id smallint, record_in_sec bigint, record_index bigint, tag smallint, type string").split(",")] + [
    "heartbeat", "sensor", "event", "diag", "geo", "battery", "net", "log", "config", "keyref", "firmware",
]
