"""Operators on the report and CLI fixtures, with expectations worked out by hand."""

import pytest
from fixtures import CLI, container, frame, make_records, report_container

from beaconry.functions import codecs, wire
from beaconry.functions.schema import TelemetryError
from beaconry.operators import compare, ranking, redact, stats, timeline, validate
from beaconry.plans import dsl
from beaconry.sources import corpus, readers, writers


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("dtl")
    for name, data in {"a": report_container(3, 4), "b": report_container(5, 6), "cli": container(CLI), "signed": container(CLI, b"cli-smoke-key"), "junk": b"garbage"}.items():
        (d / f"{name}.dtl").write_bytes(data)
    return d


@pytest.fixture(scope="module")
def a(spark, files):
    return readers.read_dtl(spark, str(files / "a.dtl")).records.cache()


@pytest.fixture(scope="module")
def b(spark, files):
    return readers.read_dtl(spark, str(files / "b.dtl")).records.cache()


@pytest.fixture(scope="module")
def cli(spark, files):
    return readers.read_dtl(spark, str(files / "cli.dtl")).records.cache()


def test_walk_and_index(a):
    assert a.count() == 22 and [r["record_index"] for r in a.orderBy("section_index", "record_in_sec").collect()] == list(range(22))
    assert {r["records"] for r in stats.by_type(a).collect()} == {2}
    assert stats.lookup(stats.postings(a), 0x7F).count() == 0 and stats.lookup(stats.postings(a), 0x10).count() == 2


def test_stats(a):
    s = {r["label"]: (r["n"], r["min"], r["max"], r["avg"]) for r in stats.numeric(a).collect()}
    assert s["hb.uptime_s"] == (2, 3001, 4001, 3501) and s["hb.seq"] == (2, 171, 178, 174.5) and s["battery.cycles"] == (2, 9, 12, 10.5)
    assert s["geo.lon_e7"] == (2, -400, -300, -350) and s["net.rx_pkts"] == (2, 24, 32, 28) and s["sensor.samples"] == (2, 3, 3, 3)
    assert s["sensor.value"] == (6, -2.25, 7, pytest.approx(19 / 6)) and s["event.payload_len"] == (2, 5, 5, 5) and s["config.pairs"] == (2, 2, 2, 2) and len(s) == 17
    assert {(r["severity"], r["records"]) for r in stats.severities(a).collect()} == {(3, 1), (4, 1)}


def test_validate(spark, a, files):
    assert tuple(validate.summary(a).first()) == (22, 0, 0, "OK")
    bad = frame(spark, [{"tag": 0x15, "battery": {"pct": 250, "temp_c_e1": 0, "cycles": 0}}, {"tag": 0x18, "config": {"pairs": [{"key": b"k", "value": b""}, {"key": b"", "value": b"v"}]}}, {"tag": 0x13, "diag": {"subsystem": 1, "blob": b"", "redacted": True}}])
    assert [r["message"] for r in validate.issues(bad).orderBy("record_index").collect()] == ["battery pct 250 over 100", "config pair 1 has empty key"]
    scan = readers.read_dtl(spark, str(files / "junk.dtl"))
    assert validate.report(scan.records, scan.errors) == ["error   section=0 record=0 container rejected: bad magic", "validate: records=0 errors=1 warnings=0 -> FAIL"]
    assert tuple(stats.totals(scan.records, scan.errors).first()) == (0, 1)


def test_diff(a, b, spark):
    assert compare.diff(a, a).count() == 0
    d = {r["record_index"]: r["why"] for r in compare.diff(a, b).collect()}
    assert len(d) == 20 and d[0] == "u.heartbeat.uptime_s 3001 != 5001" and d[5] == "u.sensor.sensor_id 3 != 5" and 8 not in d
    x = [{"tag": 0x11, "sensor": {"sensor_id": 1, "samples": [1.5, float("nan"), 2.0]}}, {"tag": 0x12, "event": {"code": 1, "payload": b"ab"}}, {"tag": 0x17, "log": {"severity": 1, "msg": b"a\0b"}}, {"tag": 0x19, "keyref": {"slot_id": 1, "label": b"x", "redacted": False}}]
    y = [{"tag": 0x11, "sensor": {"sensor_id": 1, "samples": [1.5, 0.1, 2.0]}}, {"tag": 0x12, "event": {"code": 1, "payload": b"c"}}, {"tag": 0x17, "log": {"severity": 1, "msg": b"a\0c"}}, {"tag": 0x19, "keyref": {"slot_id": 1, "label": b"y", "redacted": True}}, {"tag": 0x10, "heartbeat": {"uptime_s": 1, "seq": 1}}]
    left, right = frame(spark, x), frame(spark, y)
    assert compare.report(compare.diff(left, right)) == ["record 0: sensor.samples[1] nan != 0.100000001", "record 1: event payload differs (2 vs 1 bytes)", "record 3: u.keyref.redacted 0 != 1", "record 4: only in b (tag HEARTBEAT)"]
    assert compare.report(compare.diff(left, right, ignore_redaction=True), 1)[1:] == ["... 2 more differences suppressed"]
    assert compare.report(compare.diff(left, left)) == ["record 0: sensor.samples[1] nan != nan"]


def test_dedup(a, b):
    both = lambda x, y: writers.merged([x, y]).withColumnRenamed("input_ord", "o")
    count = lambda x, y: compare.dropped(both(x, y), order=("path", "o", "record_index")).first()[0]
    assert compare.dropped(a).first()[0] == 0 and count(a, a) == 22 and count(a, b) == 2
    once = compare.dedup(both(a, b), order=("path", "o", "record_index"))
    assert compare.dropped(once, order=("path", "o", "record_index")).first()[0] == 0


def test_sample(a):
    assert [r["record_index"] for r in ranking.sample(a, 5, 42).orderBy("record_index").collect()] == [10, 12, 16, 19, 20]
    assert ranking.reservoir(9, 3, 42).tolist() == [1, 2, 3] and ranking.sample(a, 0, 1).count() == ranking.sample(a, 99, 1).count() == 22
    assert (ranking.reservoir(1000, 7, 0) == ranking.reservoir(1000, 7, 0x9E3779B9)).all() and len(set(ranking.reservoir(1000, 7, 3))) == 7
    with pytest.raises(TelemetryError):
        ranking.reservoir(1 << 32, 5, 1)
    few = [r["record_index"] for r in ranking.sample_hashed(a, 5, 42).collect()]
    assert len(set(few)) == 5 and few == [r["record_index"] for r in ranking.sample_hashed(a.repartition(7), 5, 42).collect()]


def one_by_one(total, n, seed, most=0xFFFFFFFF):
    """The reservoir, a draw at a time."""
    held, x = list(range(n)), seed & most
    for i in range(n, total):
        while True:
            x ^= x << 13 & most
            x ^= x >> 17
            x ^= x << 5 & most
            if x < most - most % (i + 1):
                break
        if x % (i + 1) < n:
            held[x % (i + 1)] = i
    return sorted(held)


@pytest.mark.parametrize("total, n, seed", [(2, 1, 1), (50, 49, 9), (5_000, 40, 42), (70_000, 3, 0xFFFFFFFF), (70_000, 20_000, 5)])
def test_reservoir_is_the_sequential_one(total, n, seed, monkeypatch):
    assert ranking.reservoir(total, n, seed, 16, 64).tolist() == one_by_one(total, n, seed) == ranking.reservoir(total, n, seed).tolist()
    monkeypatch.setattr(ranking, "_MOST", 1 << 31)  # many draws are thrown away
    assert ranking.reservoir(1000, 10, seed, 16, 8).tolist() == thrown_away(1000, 10, seed, 1 << 31)


def thrown_away(total, n, seed, most):
    held, x = list(range(n)), seed or 0x9E3779B9
    for i in range(n, total):
        while True:
            x ^= x << 13 & 0xFFFFFFFF
            x ^= x >> 17
            x ^= x << 5 & 0xFFFFFFFF
            if x < most - most % (i + 1):
                break
        if x % (i + 1) < n:
            held[x % (i + 1)] = i
    return sorted(held)


def test_topk(a, cli):
    r = ranking.topk(a, "battery.pct", 1).collect()
    assert [(x["record_index"], x["value"]) for x in r] == [(13, 4.0)] and ranking.candidates(a, "battery.pct").count() == 2
    assert [x["value"] for x in ranking.topk(cli, "battery.pct", 3).collect()] == [15.0]
    with pytest.raises(TelemetryError):
        ranking.topk(a, "firmware.major", 1)


def test_timeline(a, cli):
    assert tuple(timeline.summary(a).drop("path").first()) == (2, 1, 0, 0)
    s = timeline.sessions(a).orderBy("session").collect()
    assert [(x["record_count"], x["first_record_index"], x["status"]) for x in s] == [(11, 0, None), (11, 11, "GAP")]
    assert timeline.report(cli)[-1] == "timeline: gaps=0 ordering-violations=1" and "ORDERING: uptime decreased (1200 -> 99)" in timeline.report(cli)[3]


@pytest.mark.parametrize("span", [1, 2, 5, 7, 1000])
def test_timeline_ranges(spark, span):
    """However a stream's order is cut, the sessions are those of one pass."""
    import random

    r = random.Random(3)
    streams = {s: [(i, r.random() < 0.3, r.randrange(1000)) for i in sorted(r.sample(range(200), 60))] for s in ("p", "q", None)}
    records = [(s, i, 0x10 if beat else 0x14, (up, i) if beat else None) for s, rows in streams.items() for i, beat, up in rows]
    df = spark.createDataFrame(records, "path string, record_index long, tag smallint, heartbeat struct<uptime_s:bigint,seq:bigint>")
    want, number = {}, {}
    for s, rows in streams.items():
        session, before = None, None
        for i, beat, up in rows:
            if beat:
                session = 0 if session is None else session + 1
                status = None if before is None else "ORDERING" if up < before else "GAP" if up - before > 120 else None
                want[s, session], before = [up, 0, i, status], up
            number[s, i] = session
            if session is not None:
                want[s, session][1] += 1
    got = {(x["path"], x["session"]): [x["uptime_s"], x["record_count"], x["first_record_index"], x["status"]] for x in timeline.sessions(df, span=span).collect()}
    assert got == want
    assert {(x["path"], x["record_index"]): x["session"] for x in timeline.attributed(df, span=span).collect()} == number


def test_generated_corpus(spark, tmp_path):
    assert corpus.write_corpus(spark, 200, 3, str(tmp_path)) == 3
    scan = readers.read_dtl(spark, str(tmp_path))
    assert scan.records.count() == 27 and scan.errors.count() == 0
    r = {x["type"]: x for x in scan.records.filter("path LIKE '%corpus_201.dtl'").collect()}
    assert (r["HEARTBEAT"]["heartbeat"]["seq"], r["GEO"]["geo"]["lon_e7"], r["BATTERY"]["battery"]["temp_c_e1"], r["SENSOR"]["sensor"]["samples"]) == (1408, -201000, 503, [301.5, -2.5])
    assert bytes(r["KEYREF"]["keyref"]["label"]) == b"device-key-slot-201" and bytes(r["DIAG"]["diag"]["blob"])[0] == (0x40 + 201) % 256 and r["LOG"]["codec_id"] == 4


def test_visit(spark, a, tmp_path):
    """Each record of a file in order, within the tasks; a callback can end the job."""
    log = str(tmp_path / "seen")

    def note(record):
        with open(log, "a") as f:
            f.write(f"{record['record_index']} {record['type']}\n")

    readers.visit(a, note)
    assert [int(x.split()[0]) for x in open(log)] == list(range(22))
    with pytest.raises(Exception, match="stopped by the callback"):
        readers.visit(stats.lookup(stats.postings(a), 0x10), lambda r: r["record_index"] < 5)


def test_merge_split_select(spark, a, b, tmp_path):
    m = writers.merged([a, b])
    assert m.count() == 44 and [r["section_index"] for r in m.select("section_index").distinct().orderBy("section_index").collect()] == list(range(0x10, 0x1B))
    writers.write_files(writers.containers(m, order=("input_ord", "record_index")), str(tmp_path / "m"))
    back = readers.read_dtl(spark, str(tmp_path / "m")).records
    assert back.count() == 44 and [r["section_type"] for r in back.orderBy("record_index").collect()][::4] == list(range(0x10, 0x1B))
    assert writers.write_files(writers.containers(writers.split(a, "split"), order=("record_index",)), str(tmp_path / "s")) == 11
    assert readers.read_dtl(spark, str(tmp_path / "s" / "split_LOG.dtl")).records.count() == 2
    assert dsl.select(a, "type == LOG").count() == 2
    writers.write_split(a, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("type = 'GEO'").count() == 2


@pytest.mark.parametrize("codec", [0, 1, 3, 4, 6])
def test_repack_and_sign(spark, a, tmp_path, codec):
    rows = writers.repack(a, codec)
    writers.write_files(rows, str(tmp_path))
    scan = readers.read_dtl(spark, str(tmp_path), mode="failfast")
    assert compare.diff(a, scan.records).count() == 0 and {r["codec_id"] for r in scan.records.collect()} == {codec}
    data = (tmp_path / "a.dtl").read_bytes()
    (tmp_path / "again").mkdir()
    writers.write_files(writers.containers(scan.records, key=b"k"), str(tmp_path / "again"))
    signed = (tmp_path / "again" / "a.dtl").read_bytes()
    assert signed[12:-32] == data[12:]  # the same bytes but the flag, its checksum and the trailer
    assert readers.verify(spark, str(tmp_path / "again"), b"k").first()["verdict"] == "OK"


def test_bad_sinks(a):
    for how in ({"codec": 99}, {"key": b""}):
        with pytest.raises(TelemetryError):
            writers.containers(a, **how)


def test_text_files(spark, a, tmp_path):
    for form, read in (("csv", readers.read_csv), ("json", readers.read_json)):
        lines = (writers.csv_lines if form == "csv" else writers.json_lines)(a)
        (tmp_path / f"x.{form}").write_text(writers.document(lines, form))
        assert compare.diff(a, read(spark, str(tmp_path / f"x.{form}"))).count() == 0
        writers.export(a, form, str(tmp_path / form))
        assert spark.read.text(str(tmp_path / form)).count() == 22
    (tmp_path / "bad.csv").write_text("index,tag\n0,HEARTBEAT,1\n")
    with pytest.raises(Exception, match="malformed record"):
        readers.read_csv(spark, str(tmp_path / "bad.csv")).count()


def test_cli_fixture(spark, cli, files):
    lines = [r["line"] for r in writers.printed_lines(redact.redact_keystore(cli)).orderBy("record_index").collect()]
    assert lines[0] == "0 HEARTBEAT uptime_s=1200 seq=5" and lines[3] == '3 KEYREF slot_id=2 label_len=0 label="" redacted=1'
    assert lines[4] == "4 DIAG subsystem=0xff00 blob_len=0 blob= redacted=1" and lines[5] == "5 DIAG subsystem=0x0042 blob_len=4 blob=deadbeef redacted=0"
    assert lines[8] == "8 CONFIG pair_count=1 mode=fast"
    assert redact.redact(cli).filter("keyref.redacted").count() == 1
    assert dsl.query(cli, "seq > 3").count() == 1 and dsl.query(cli, "!label && type == KEYREF").count() == 1 and dsl.select(cli, "!label && type == KEYREF").count() == 0
    s = readers.read_sections(spark, str(files / "cli.dtl")).orderBy("section_index").collect()
    assert [(x["version"], x["flags"], x["has_mac"], x["codec_id"]) for x in s] == [(1, 0, False, 0), (1, 0, False, 3), (1, 0, False, 4)]
    verdicts = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in readers.verify(spark, str(files), b"cli-smoke-key").collect()}
    assert verdicts == {"a.dtl": "no-hmac", "b.dtl": "no-hmac", "cli.dtl": "no-hmac", "signed.dtl": "OK", "junk.dtl": "bad-container"}
    with pytest.raises(Exception, match="bad magic"):
        readers.read_dtl(spark, str(files / "junk.dtl"), mode="failfast").records.count()


def test_nan_records_never_equal(spark):
    r = [{"tag": 0x11, "sensor": {"sensor_id": 1, "samples": [float("nan")]}}] * 3 + [{"tag": 0x11, "sensor": {"sensor_id": 1, "samples": [z]}} for z in (0.0, -0.0)]
    assert compare.dropped(frame(spark, r)).first()[0] == 1


def test_writer_limits():
    assert codecs.CODECS[3] == "lz77" and wire.MOST_SECTIONS == 64
    assert make_records(4)[8]["config"]["pairs"][0]["value"] == b"fast"
