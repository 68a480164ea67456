"""Queries over containers and text files: records are framed, coded, signed, written, read back and compared.

The SQL side packs each record's payload itself, so a wrong byte shows.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs, text, wire
from ..operators import stats, validate
from ..sources import readers, shared, writers
from . import telemetry_view as view
from .catalog import query

KEY = b"example key"

# ---- the SQL side --------------------------------------------------------------------------------------


def _le(x: str, width: int) -> str:
    """SQL: a whole number as little-endian hex, negative ones as their two's complement."""
    v = f"((CAST({x} AS BIGINT) + {1 << 8 * width}) % {1 << 8 * width})"
    return "(" + " || ".join(f"lpad(lower(to_hex(({v} >> {8 * i}) & 255)), 2, '0')" for i in range(width)) + ")"


def _float(x: str) -> str:
    """SQL: the 32-bit pattern of a normal number or zero."""
    power = f"(CASE WHEN abs({x}) >= pow(2, round(log2(abs({x})))) THEN round(log2(abs({x}))) ELSE round(log2(abs({x}))) - 1 END)"
    return f"CASE WHEN {x} = 0 THEN 0 ELSE (CASE WHEN {x} < 0 THEN 2147483648 ELSE 0 END) + CAST(({power} + 127) * 8388608 + (abs({x}) / pow(2, {power}) - 1) * 8388608 AS BIGINT) END"


def _bytes(x: str) -> str:
    return f"lower(hex(encode({x})))"


def _counted(x: str, width: int) -> str:
    return f"{_le(f'octet_length(encode({x}))', width)} || {_bytes(x)}"


_FLOATS = f"array_to_string(list_transform(list_transform(samples, lambda x: CAST(x AS DOUBLE)), lambda x: {_le(_float('x'), 4)}), '')"
_PAYLOAD = f"""CASE tag WHEN 16 THEN {_le('uptime_s', 4)} || {_le('seq', 4)} WHEN 17 THEN {_le('sensor_id', 2)} || {_le('len(samples)', 1)} || {_FLOATS}
  WHEN 18 THEN {_le('code', 2)} || {_counted('payload', 2)} WHEN 19 THEN {_le('subsystem', 2)} || {_counted('blob', 2)}
  WHEN 20 THEN {_le('lat_e7', 4)} || {_le('lon_e7', 4)} || {_le('alt_mm', 4)} WHEN 21 THEN {_le('pct', 1)} || {_le('temp_c_e1', 2)} || {_le('cycles', 4)}
  WHEN 22 THEN {_le('iface_id', 1)} || {_le('rx_bytes', 4)} || {_le('tx_bytes', 4)} || {_le('rx_pkts', 4)} || {_le('tx_pkts', 4)}
  WHEN 23 THEN {_le('severity', 1)} || {_counted('msg', 2)} WHEN 24 THEN '02' || {_counted('k0', 1)} || {_counted('v0', 1)} || {_counted("'type'", 1)} || {_counted('v1', 1)}
  WHEN 25 THEN {_le('slot_id', 1)} || {_counted('label', 1)} ELSE {_le('major', 2)} || {_le('minor', 2)} || {_le('patch', 2)} || {_bytes('hash')} END"""
#: Containers of bounded size: 500 indexes, or eight documents.
_SQL_PATH = f"'c' || record_index // {view.BLOCK} || '_' || record_index % {view.BLOCK} // CASE WHEN record_index // {view.BLOCK} = 4 THEN 524288 ELSE 500 END"
FRAMES = f""", fr AS (SELECT *, {_SQL_PATH} AS path, {_PAYLOAD} AS payload_hex FROM rec),
pl AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY record_index) - 1 AS BIGINT) AS place FROM fr)
"""
_PLACED = FRAMES + "SELECT path, place AS record_in_sec, CAST(tag AS BIGINT) AS tag, md5(payload_hex) AS payload FROM pl"


# ---- the Spark side --------------------------------------------------------------------------------------


def _pathed(records: DataFrame) -> DataFrame:
    size = F.when(F.col("section_index") == 4, F.lit(524288)).otherwise(F.lit(500))
    return records.withColumn("path", F.concat(F.lit("c"), F.col("section_index"), F.lit("_"), F.floor(F.col("record_in_sec") / size).cast("string")))


def _contained(spark: SparkSession, sf_dir: str, codec: int, key: bytes | None = None) -> DataFrame:
    """All records as containers; a container holds the records of one table."""
    return writers.containers(_pathed(view.all_records(spark, sf_dir)), order=("record_index",), codec=codec, key=key)


def _payloads(records: DataFrame) -> DataFrame:
    """``path, record_in_sec, tag`` and the payload's digest, packed again from the record."""

    @F.pandas_udf("string")
    def packed(frame: pd.Series) -> pd.Series:
        return frame.map(lambda x: bytes(x)[3:].hex())

    rows = writers.framed(records, "path", "record_in_sec", "tag")
    return rows.select("path", "record_in_sec", F.col("tag").cast("long").alias("tag"), F.md5(packed("frame")).alias("payload"))


def _decoded(rows: DataFrame) -> DataFrame:
    """Containers in rows, decoded strictly."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = [(path, at["record_in_sec"], r["tag"], wire.pack_payload(r).hex()) for _, at, r in wire.scan_strict(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["path", "record_in_sec", "tag", "payload"])

    return rows.mapInArrow(run, "path string, record_in_sec long, tag long, payload string").withColumn("payload", F.md5("payload"))


def _repack(codec: int) -> None:
    @query(_PLACED, f"repack_roundtrip_{codecs.CODECS[codec]}")
    def run(spark, sf_dir):
        return _decoded(_contained(spark, sf_dir, codec))


for _codec in (0, 1, 3, 4, 6):
    _repack(_codec)


def _words(codec: int) -> None:
    """varint and delta carry whole 32-bit words: sections of heartbeats, whose frames are 11 bytes, four at a time."""

    @query(f"WITH w AS (SELECT event_id // 400 AS g, event_id % 400 AS i, {_le('user_id', 4)} || {_le('event_id', 4)} AS h FROM events) SELECT 'w' || g AS path, CAST(i AS BIGINT) AS record_in_sec, CAST(16 AS BIGINT) AS tag, md5(h) AS payload FROM w", f"repack_roundtrip_{codecs.CODECS[codec]}")
    def run(spark, sf_dir):
        e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id IS NOT NULL")
        beats = view.records(e, "w", 0, "event_id", {"heartbeat": view.struct(uptime_s="user_id", seq="event_id")})
        beats = beats.withColumn("path", F.concat(F.lit("w"), F.expr("record_index div 400")))
        whole = F.count(F.lit(1)).over(Window.partitionBy("path")) % 4 == 0
        beats = beats.withColumn("codec_id", F.when(whole, codec).otherwise(0).cast("smallint"))
        return _decoded(writers.containers(beats, order=("record_index",)))


for _codec in (2, 5):
    _words(_codec)


@query(FRAMES + "SELECT DISTINCT path, 'OK' AS signed, 'FAIL' AS wrong_key, 'no-key' AS no_key FROM fr")
def sign_verify(spark, sf_dir):
    def verdict(key):
        @F.pandas_udf("string")
        def check(c: pd.Series) -> pd.Series:
            return c.map(lambda x: wire.verify(bytes(x), key))

        return check("content")

    c = _contained(spark, sf_dir, 0, KEY)
    return c.select("path", verdict(KEY).alias("signed"), verdict(b"other key").alias("wrong_key"), verdict(None).alias("no_key"))


# ---- through files ----------------------------------------------------------------------------------------


def _written(spark: SparkSession, rows: DataFrame) -> str:
    """The folder of ``rows`` (path, content), one file each."""
    folder = shared.new_folder(spark)
    writers.write_files(rows, folder)
    return folder


def _named(df: DataFrame) -> DataFrame:
    """Files by their names, without the folder and the suffix."""
    return df.withColumn("path", F.regexp_extract("path", r"([^/.]+)(?:\.[a-z]+)?$", 1))


@query(_PLACED)
def files_read_containers(spark, sf_dir):
    """Containers in files, read leniently."""
    return _payloads(_named(readers.read_dtl(spark, _written(spark, _contained(spark, sf_dir, 1))).records))


@query(_PLACED)
def files_read_failfast(spark, sf_dir):
    return _payloads(_named(readers.read_dtl(spark, _written(spark, _contained(spark, sf_dir, 0, KEY)), "failfast").records))


_SIZES = FRAMES + "SELECT path, CAST(0 AS BIGINT) AS section_index, CAST(1 AS BIGINT) AS version, {signed} AS has_mac, CAST(1 AS BIGINT) AS section_type, CAST(0 AS BIGINT) AS codec_id, CAST(sum(3 + length(payload_hex) // 2) AS BIGINT) AS raw_len, CAST(sum(3 + length(payload_hex) // 2) AS BIGINT) AS comp_len, CAST(0 AS BIGINT) AS \"offset\" FROM fr GROUP BY path"


@query(_SIZES.format(signed="true"))
def files_dump(spark, sf_dir):
    """The section tables of signed containers in files."""
    s = _named(readers.read_sections(spark, _written(spark, _contained(spark, sf_dir, 0, KEY))))
    return s.select("path", *[F.col(c).cast("long").alias(c) for c in ("section_index", "version")], "has_mac", *[F.col(c).cast("long").alias(c) for c in ("section_type", "codec_id", "raw_len", "comp_len", "offset")])


@query(FRAMES + "SELECT DISTINCT path, 'OK' AS verdict FROM fr")
def files_verify(spark, sf_dir):
    return _named(readers.verify(spark, _written(spark, _contained(spark, sf_dir, 0, KEY)), KEY))


def _documents(records: DataFrame, form: str) -> DataFrame:
    """``path, content``: the text export of each container's records."""
    index = F.col("place")
    r = _pathed(records).withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("record_index")) - 1)
    row = (text.csv_row if form == "csv" else text.json_row)(index)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", row.alias("line")))), lambda x: x["line"])
    head, sep, tail = (text.CSV_HEADER + "\n", "\n", "\n") if form == "csv" else ("[\n", ",\n", "\n]\n")
    return r.groupBy("path").agg(F.encode(F.concat(F.lit(head), F.array_join(lines, sep), F.lit(tail)), "UTF-8").alias("content")).select(F.concat("path", F.lit("." + form)).alias("path"), "content")


@query(_PLACED)
def files_read_json(spark, sf_dir):
    """JSON exports in files, imported: floats, texts and empty values come back as they were."""
    return _payloads(_named(readers.read_json(spark, _written(spark, _documents(view.all_records(spark, sf_dir), "json")))))


_NO_SENSOR = FRAMES + "SELECT path, place AS record_in_sec, CAST(tag AS BIGINT) AS tag, md5(payload_hex) AS payload FROM pl WHERE tag <> 17"


@query(_NO_SENSOR, chunk=500)
def files_read_csv(spark, sf_dir):
    """CSV exports in files, imported: texts in chunks that a field can hold, no samples (CSV rounds them)."""
    r = view.all_records(spark, sf_dir, chunk=500).filter("sensor IS NULL")
    return _payloads(_named(readers.read_csv(spark, _written(spark, _documents(r, "csv")))))


@query(FRAMES + """SELECT path, place AS record_in_sec, CAST(tag AS BIGINT) AS tag, md5(payload_hex) AS payload FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY record_index) - 1 AS BIGINT) AS place FROM (SELECT * EXCLUDE (path), 'o' || path AS path FROM fr WHERE tag IN (18, 25)))""")
def import_to_container(spark, sf_dir):
    """JSON files imported, written as containers of one stored section of type 1, and read back."""
    r = view.all_records(spark, sf_dir).filter("tag IN (18, 25)")
    imported = _named(readers.read_json(spark, _written(spark, _documents(r, "json"))))
    made = writers.containers(imported.withColumn("path", F.concat(F.lit("o"), F.col("path"))))
    folder = _written(spark, made)
    sections = _named(readers.read_sections(spark, folder)).filter("section_type = 1 AND codec_id = 0 AND section_index = 0").select("path")
    return _payloads(_named(readers.read_dtl(spark, folder).records).join(sections, "path", "left_semi"))


# ---- faults ------------------------------------------------------------------------------------------------

#: Order keys make the containers: each tenth one has a wrong first byte, and every seventh record an unknown tag.
_FAULTY = """WITH o AS (SELECT o_orderkey AS k, o_orderkey // 1000 AS g, o_orderkey // 1000 % 10 = 9 AS broken, o_orderkey % 7 = 0 AS unknown FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS place FROM o)
"""


def _faulty(spark: SparkSession, sf_dir: str) -> readers.Scan:
    r = view.event_codes(spark, sf_dir).withColumn("path", F.concat(F.lit("f"), F.expr("record_in_sec div 1000")))

    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("record_in_sec", kind="stable")
        raw = b"".join((b"\x7f" + x[1:] if k % 7 == 0 else x) for k, x in zip(f["record_in_sec"], map(bytes, f["frame"])))
        data = wire.build_container([(1, 0, raw)])
        path = f["path"].iloc[0]
        return pd.DataFrame({"path": [path], "content": [b"X" + data[1:] if int(path[1:]) % 10 == 9 else data]})

    made = writers.framed(r, "path", "record_in_sec").groupBy("path").applyInPandas(build, "path string, content binary")
    return readers.read_dtl(spark, _written(spark, made))


@query(_FAULTY + "SELECT 'f' || g AS path, CAST(place AS BIGINT) AS record_in_sec, 'BADRECORD' AS error, false AS fatal FROM p WHERE unknown AND NOT broken UNION ALL SELECT DISTINCT 'f' || g, NULL, 'BADMAGIC', true FROM p WHERE broken")
def files_read_faults(spark, sf_dir):
    return _named(_faulty(spark, sf_dir).errors).select("path", "record_in_sec", "error", "fatal")


@query(_FAULTY + "SELECT count(*) FILTER (NOT unknown AND NOT broken) AS records, count(*) FILTER (unknown AND NOT broken) + count(DISTINCT g) FILTER (broken) AS parse_errors FROM p")
def stats_parse_errors(spark, sf_dir):
    scan = _faulty(spark, sf_dir)
    return stats.totals(scan.records, scan.errors)


@query(_FAULTY + """SELECT 'f' || g AS path, CAST(0 AS BIGINT) AS section_index, CAST(place AS BIGINT) AS record_in_sec, 'VAL-16' AS rule, 'error' AS severity, 'decode/parse failure: malformed record' AS message FROM p WHERE unknown AND NOT broken
  UNION ALL SELECT DISTINCT 'f' || g, 0, 0, 'VAL-17', 'error', 'container rejected: bad magic' FROM p WHERE broken""")
def validate_read_faults(spark, sf_dir):
    scan = _faulty(spark, sf_dir)
    found = _named(validate.issues(scan.records, scan.errors)).filter("rule IN ('VAL-16', 'VAL-17')")
    return found.select("path", F.col("section_index").cast("long").alias("section_index"), "record_in_sec", "rule", "severity", "message")
