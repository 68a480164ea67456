"""Golden payloads, strict decoders, round trips and the container's order of checks."""

import struct
import zlib

import pytest
from fixtures import CLI, container, make_records, report_container, section
from hypothesis import given, settings
from hypothesis import strategies as st

from beaconry.functions import codecs, rows, text, wire
from beaconry.functions.schema import TelemetryError


def code_of(f, *a):
    with pytest.raises(TelemetryError) as e:
        f(*a)
    return e.value.code


# Payloads that the format demands, byte for byte.
GOLDEN = [
    (0x10, "40E201002A000000", {"heartbeat": {"uptime_s": 123456, "seq": 42}}),
    (0x15, "57C9FFB0040000", {"battery": {"pct": 87, "temp_c_e1": -55, "cycles": 1200}}),
    (0x12, "AB0005000102030405", {"event": {"code": 0xAB, "payload": bytes(range(1, 6))}}),
    (0x17, "03090068656C6C6F206C6F67", {"log": {"severity": 3, "msg": b"hello log"}}),
    (0x18, "02037665720331" + "2E30046D6F64650466617374", {"config": {"pairs": [{"key": b"ver", "value": b"1.0"}, {"key": b"mode", "value": b"fast"}]}}),
    (0x19, "050A73656E736F722D6B6579", {"keyref": {"slot_id": 5, "label": b"sensor-key", "redacted": False}}),
    (0x13, "42000400CAFEBABE", {"diag": {"subsystem": 0x42, "blob": bytes.fromhex("cafebabe"), "redacted": False}}),
    (0x11, "341203" + struct.pack("<3f", 1.5, -2.25, 3.0e10).hex(), {"sensor": {"sensor_id": 0x1234, "samples": [1.5, -2.25, struct.unpack("<f", struct.pack("<f", 3e10))[0]]}}),
]


@pytest.mark.parametrize("tag,payload,body", GOLDEN)
def test_golden(tag, payload, body):
    data = bytes.fromhex(payload)
    record = wire.parse_record(tag, data)
    assert record == {"tag": tag, **body}
    assert wire.pack_payload(record) == data
    for n in range(len(data)):  # every truncation is rejected
        assert code_of(wire.parse_record, tag, data[:n]) in ("TRUNCATED", "BADRECORD")
    assert code_of(wire.parse_record, tag, data + b"\0") == "BADRECORD"


def test_record_rules():
    net = lambda i: struct.pack("<BIIII", i, 1, 2, 3, 4)
    assert wire.parse_record(0x16, net(249))["net"]["iface_id"] == 249
    assert code_of(wire.parse_record, 0x16, net(250)) == "BADRECORD"
    assert code_of(wire.parse_record, 0x17, b"\x08\0\0") == "BADRECORD"
    assert code_of(wire.parse_record, 0x99, b"") == "BADRECORD"
    assert code_of(wire.pack_payload, {"tag": 0x18, "config": {"pairs": [{"key": b"k" * 256, "value": b""}]}}) == "RANGE"
    assert wire.pack_payload({"tag": 0x18, "config": {"pairs": [{"key": b"a\0b", "value": b"c"}]}}) == b"\x01\x01a\x01c"
    assert code_of(wire.frame_words, 1, [0] * 16384) == "RANGE"
    assert wire.count_frames(section(make_records(3))) == 11


# Coded bytes that the codecs demand.
CODEC_CASES = [
    (1, b"AAAAABBBC", bytes.fromhex("054103420143")), (6, b"a", b"ME======"), (2, struct.pack("<I", 16384), bytes.fromhex("808001")),
]


@pytest.mark.parametrize("codec,plain,coded", CODEC_CASES)
def test_codec_vectors(codec, plain, coded):
    assert codecs.encode(codec, plain) == coded and codecs.decode(codec, coded, 100) == plain


@pytest.mark.parametrize("codec,data,error", [
    (1, b"\x05", "TRUNCATED"), (1, b"\0A", "BADRECORD"), (2, b"\x80", "TRUNCATED"), (2, b"\xff\xff\xff\xff\x10", "RANGE"), (2, b"\x80" * 5 + b"\x01", "RANGE"),
    (3, bytes.fromhex("010000"), "BADRECORD"), (3, bytes.fromhex("02410400"), "BADRECORD"), (3, b"\x01\0", "TRUNCATED"), (3, bytes.fromhex("02410100"), "BADRECORD"),
    (4, b"\x01\0\x01A\x01\0", "BADRECORD"), (4, b"\x02\0\x01A", "TRUNCATED"), (4, b"\x01\0\x01A\0", "TRUNCATED"), (5, b"\0\0", "TRUNCATED"),
    (6, b"ABC", "TRUNCATED"), (6, b"a=======", "BADRECORD"), (6, b"AAAAAA==" [:6] + b"==", None), (6, b"AAA=====", "BADRECORD"), (9, b"", "BADRECORD"),
])
def test_codec_negatives(codec, data, error):
    if error:
        assert code_of(codecs.decode, codec, data, 100) == error


def test_codec_limits():
    for c in (0, 1, 3, 4, 6):
        data = codecs.encode(c, b"A" * 512)
        assert codecs.decode(c, data, 512) == b"A" * 512 and code_of(codecs.decode, c, data, 511) == "RANGE"
    assert code_of(codecs.encode, 2, b"abc") == code_of(codecs.encode, 5, b"abc") == "TRUNCATED"
    assert codecs.decode(3, codecs.encode(3, b"ABC" * 100), 300) == b"ABC" * 100


def slow_lz77(data: bytes) -> list:
    """Greedy tokens by trying every start: the earliest of the longest matches."""
    out, p = [], 0
    while p < len(data):
        best, where = 0, 0
        for s in range(max(0, p - 4096), p):
            n = 0
            while n < 18 and p + n < len(data) and data[s + n] == data[p + n]:
                n += 1
            if n > best:
                best, where = n, s
        out.append((best, p - where) if best >= 3 else data[p])
        p += best if best >= 3 else 1
    return out


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"ab", b"abc", b"aaaa", b"\0", b"xyz" * 9]), max_size=40).map(b"".join), st.integers(0, 5000))
def test_codec_round_trips(data, pad):
    for c in codecs.CODECS:
        plain = data + bytes(-len(data) % 4) if c in (2, 5) else data
        assert codecs.decode(c, codecs.encode(c, plain), len(plain)) == plain
    coded, at, tokens = codecs.encode(3, data), 0, []
    while at < len(coded):
        flag = coded[at]
        at += 1
        for bit in range(8):
            if at >= len(coded):
                break
            if flag >> bit & 1:
                tokens.append(((coded[at + 1] & 15) + 3, (coded[at] | coded[at + 1] >> 4 << 8) + 1))
                at += 2
            else:
                tokens.append(coded[at])
                at += 1
    assert tokens == slow_lz77(data)


def test_container_checks():
    good = report_container(3, 4)
    assert [s["type"] for s in wire.parse_container(good)["sections"]] == [1, 2]
    one = wire.build_container([(1, 0, b"\x10\x00\x00")])
    assert one[:12].hex().upper() == "44544C0101000100596B32FB"

    def head(**change):
        h = bytearray(one[:8])
        for i, v in change.items():
            h[int(i[1:])] = v
        return bytes(h) + struct.pack("<I", zlib.crc32(bytes(h))) + one[12:]

    assert code_of(wire.parse_container, b"") == "TRUNCATED"
    assert code_of(wire.parse_container, head(b0=0)) == "BADMAGIC"
    assert code_of(wire.parse_container, head(b4=2)) == "BADVERSION"
    assert code_of(wire.parse_container, head(b5=2)) == "BADHEADER"
    assert code_of(wire.parse_container, one[:8] + b"\0\0\0\0" + one[12:]) == "BADHEADER"
    assert code_of(wire.parse_container, one[:-1]) == "RANGE"
    assert code_of(wire.parse_container, head(b5=1)) == "TRUNCATED"
    assert code_of(wire.parse_container, head(b6=9)) in ("TRUNCATED", "BADRECORD")
    assert code_of(wire.build_container, [(1, 0, b"")]) == "RANGE"
    assert code_of(wire.build_container, [(1, 0, b"x")] * 65) == "OOM"


def test_sign_and_verify():
    key = b"cli-smoke-key"
    data = container(CLI, key)
    assert wire.verify(data, key) == "OK" and wire.verify(data, b"no") == "FAIL" and wire.verify(data, None) == "no-key"
    assert wire.verify(container(CLI), key) == "no-hmac" and wire.verify(b"junk", key) == "bad-container"
    assert wire.verify(data[:40] + bytes([data[40] ^ 1]) + data[41:], key) == "FAIL"
    assert wire.mac(b"a", b"bc") != wire.mac(b"ab", b"c") and len(wire.derive_key(b"seed")) == 32
    assert set(wire.keystore(b"seed")) == {1, 2}


def test_walk_and_strict():
    bad = section(make_records(3)[:2]) + wire.frame(0x99, b"x") + section(make_records(3)[2:3]) + b"\x10\xff"
    data = wire.build_container([(1, 0, bad), (2, 0, section(make_records(4)[:1]))])
    events = list(wire.walk(data))
    assert [(e[0], e[1]["record_in_sec"], e[1].get("record_index")) for e in events] == [("record", 0, 0), ("record", 1, 1), ("error", 2, None), ("record", 3, 2), ("record", 0, 3)]
    assert code_of(lambda: list(wire.scan_strict(data))) == "BADRECORD"
    assert [e[2] for e in wire.walk(data, max_decode=30)][0] == "RANGE"


def test_text_rows():
    assert rows.csv_fields(b'0,LOG,5,"a ""b"", c",,,') == [b"0", b"LOG", b"5", b'a "b", c', b"", b"", b""]
    for line in (b'0,LOG,5,"open', b'0,LOG,"a"b', b"1,2,3,4,5,6,7,8,9", b"0," + b"x" * 4096):
        assert code_of(rows.csv_fields, line) == "BADRECORD"
    doc = b"index,tag,f0,f1,f2,f3,f4,f5\r\n0,HEARTBEAT,1,2,,,,\r\n\r\n1,SENSOR,7,2,1.5,,-2\n"
    assert rows.csv_document(doc) == [{"tag": 16, "heartbeat": {"uptime_s": 1, "seq": 2}}, {"tag": 17, "sensor": {"sensor_id": 7, "samples": [1.5, -2.0]}}]
    for line in (b"0,heartbeat,1,2", b"0,HEARTBEAT,1", b"0,HEARTBEAT,-1,2", b"0,BATTERY,256,1,1", b"0,GEO,2147483648,0,0", b"0,SENSOR,1,1,1.5abc", b"0,DIAG,1,2,0,ab", b"0,EVENT,1,1,abcd", b"0,CONFIG,3,a,b"):
        assert code_of(rows.csv_document, line) == "BADRECORD"
    record = rows.json_document(b'[{"index":0,"tag":24,"type":"x","pairs":{"b":"1","a":"2","b":"3"}}]')[0]
    assert [(p["key"], p["value"]) for p in record["config"]["pairs"]] == [(b"b", b"1"), (b"a", b"2"), (b"b", b"3")]
    for bad in (b"{}", b"[1]", b"[] x", b'[{"tag":16,"uptime_s":1}]', b'[{"tag":16,"uptime_s":4294967296,"seq":1}]', b'[{"tag":23,"severity":1,"msg":"\\u00e9"}]', b"[" * 65 + b"]" * 65,
                b'[{"tag":17,"sensor_id":1,"samples":[' + b",".join([b"1"] * 256) + b"]}]", b'[{"tag":26,"version":"1.2","hash_hex":"0011223344556677"}]'):
        assert code_of(rows.json_document, bad) == "BADRECORD"
    assert text.hexdump(b"AB\x00" + bytes(15)).splitlines()[0] == "00000000  41 42 00 00 00 00 00 00  00 00 00 00 00 00 00 00  |AB..............|"
