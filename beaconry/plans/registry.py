"""Queries over the driver's tables and their SQL counterparts, one entry per operator.

Each runs over its whole tables through the record view of ``telemetry_view``; the SQL side
starts from the same view as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.schema import TAGS, name_tag, tag_name
from ..operators import compare, ranking, redact, stats, timeline, validate
from ..sources import readers, writers
from . import dsl
from . import telemetry_view as view
from .catalog import QUERIES, SQL, query


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: statistics of the records that a predicate keeps."""
    return stats.numeric(dsl.select(view.all_records(spark, sf_dir), "battery.pct <= 100 || type == HEARTBEAT || count > 0"))


# ---- filters ----------------------------------------------------------------------------------------

#: Name: expression and the condition that says the same in SQL over the flat record view.
FILTERS = {
    "flt_type": ("type == GEO", "tag = 20"),
    "flt_type_constant_folds_case": ("type == battery || TYPE == 5", "tag = 21"),
    "flt_bare_field": ("cycles >= 7", "cycles >= 7"),
    "flt_dotted": ("net.rx_bytes < 2500", "rx_bytes < 2500"),
    "flt_dotted_qualifier_case": ("Battery.temp < 0 || NET.tx_pkts == 2", "temp_c_e1 < 0 OR tx_pkts = 2"),
    "flt_and_or": ("battery.pct > 90 && battery.cycles < 6 || net.iface >= 10 && rx_pkts == 4", "(pct > 90 AND cycles < 6) OR (iface_id >= 10 AND rx_pkts = 4)"),
    "flt_not_missing": ("!(alt <= 9000)", "coalesce(alt_mm > 9000, true)"),
    "flt_not_binds_tighter": ("!severity == 1", "coalesce(severity, 0) = 0"),
    "flt_ne_missing": ("temp != 12", "temp_c_e1 <> 12"),
    "flt_mixed_types": ('label != 40 && slot != "x"', "label IS NOT NULL"),
    "flt_string_order": ('label >= "Supplier#000000005" && label < "Supplier#000000008"', "label >= 'Supplier#000000005' AND label < 'Supplier#000000008'"),
    "flt_string_escape": (r'msg == "{\"k\": 42}" || msg < "{\"k\": 2"', """msg = '{"k": 42}' OR msg < '{"k": 2'"""),
    "flt_config_key": ('config.brand == "Brand#13" || type == CONFIG && config.type > "S"', "(k0 = 'brand' AND v0 = 'Brand#13') OR v1 > 'S'"),
    "flt_config_bare_key": ('brand == "Brand#13"', "k0 = 'brand' AND v0 = 'Brand#13'"),
    "flt_truthy": ("msg || len", "length(msg) > 0 OR length(payload) > 0 OR length(blob) > 0"),
    "flt_sensor_count": ("sensor.count >= 3 && id < 5", "len(samples) >= 3 AND sensor_id < 5"),
    "flt_diag_length": ("diag.len > 20000", "octet_length(encode(blob)) > 20000"),
    "flt_boolean_operand": ("(seq > 250 || pct > 60) == 1", "coalesce(seq > 250, false) OR coalesce(pct > 60, false)"),
    "flt_nested": ("!((tx_pkts < 1) || (((net.rx_pkts > 2)))) && type == NET", "tx_pkts >= 1 AND rx_pkts <= 2"),
    "flt_unknown_field": ("battery.voltage > 0 || altitude <= 3 || code == 17", "code = 17"),
    "flt_unknown_negated": ("!(humidity < 9) && slot > 3", "slot_id > 3"),
    "flt_firmware": ("major == 1 && minor > 2 && patch <= 1", "major = 1 AND minor > 2 AND patch <= 1"),
}


def _filter(expression: str, condition: str, name: str) -> None:
    @query(f"SELECT record_index, CAST(tag AS BIGINT) AS tag FROM rec WHERE {condition}", name)
    def run(spark, sf_dir):
        return dsl.select(view.all_records(spark, sf_dir), expression).select("record_index", F.col("tag").cast("long").alias("tag"))


for _name, (_expression, _condition) in FILTERS.items():
    _filter(_expression, _condition, _name)


@query("SELECT record_index, type FROM rec WHERE subsystem >= 65280 OR slot_id IN (1, 2) OR blob = ''")
def flt_query_after_redaction(spark, sf_dir):
    """``query`` blanks before it filters, ``select`` doesn't."""
    hit = dsl.query(view.all_records(spark, sf_dir), "type == DIAG && !diag.len || type == KEYREF && !label")
    return hit.select("record_index", "type")


@query("SELECT type, count(*) AS kept FROM rec WHERE length(msg) > 0 OR seq > 100 GROUP BY type")
def select_kept(spark, sf_dir):
    return dsl.select(view.all_records(spark, sf_dir), "log.len > 0 || seq > 100").groupBy("type").agg(F.count(F.lit(1)).alias("kept"))


# ---- aggregations -----------------------------------------------------------------------------------

_SQL_VALUES = {
    "hb.uptime_s": "uptime_s", "hb.seq": "seq", "battery.pct": "pct", "battery.cycles": "cycles", "geo.lat_e7": "lat_e7", "geo.lon_e7": "lon_e7", "geo.alt_mm": "alt_mm",
    "net.rx_bytes": "rx_bytes", "net.tx_bytes": "tx_bytes", "net.rx_pkts": "rx_pkts", "net.tx_pkts": "tx_pkts", "sensor.samples": "len(samples)",
    "event.code": "code", "event.payload_len": "length(payload)", "diag.blob_len": "octet_length(encode(blob))", "config.pairs": "CASE WHEN v1 IS NOT NULL THEN 2 END",
}
_NUMERIC = " UNION ALL ".join(f"SELECT '{k}' AS label, CAST({v} AS DOUBLE) AS v FROM rec" for k, v in _SQL_VALUES.items()) + " UNION ALL SELECT 'sensor.value', CAST(unnest(samples) AS DOUBLE) FROM rec"


@query(f", vals AS ({_NUMERIC}) SELECT label, count(v) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS avg, round(sum(v), 4) AS sum FROM vals WHERE v IS NOT NULL GROUP BY label")
def stats_numeric(spark, sf_dir):
    n = stats.numeric(view.all_records(spark, sf_dir))
    return n.select("label", "n", "min", "max", F.round("avg", 6).alias("avg"), F.round("sum", 4).alias("sum"))


@query("SELECT sensor_id, count(DISTINCT record_index) AS records, count(x) AS n, CAST(min(x) AS DOUBLE) AS min, CAST(max(x) AS DOUBLE) AS max FROM (SELECT record_index, sensor_id, unnest(CASE WHEN len(samples) = 0 THEN [NULL] ELSE samples END) AS x FROM rec WHERE tag = 17) GROUP BY sensor_id")
def stats_sensor_explode(spark, sf_dir):
    s = view.sensors(spark, sf_dir).select(F.col("sensor.sensor_id").cast("long").alias("sensor_id"), F.col("sensor.samples").alias("s"))
    return s.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("s")).cast("long").alias("n"), F.min(F.array_min("s")).cast("double").alias("min"), F.max(F.array_max("s")).cast("double").alias("max"))


@query("SELECT CAST(tag AS BIGINT) AS tag, type, count(*) AS records FROM rec GROUP BY ALL")
def stats_by_type(spark, sf_dir):
    return stats.by_type(view.all_records(spark, sf_dir)).select(F.col("tag").cast("long").alias("tag"), "type", "records")


@query("SELECT CAST(severity AS BIGINT) AS severity, count(*) AS records FROM rec WHERE tag = 23 GROUP BY ALL")
def stats_severity(spark, sf_dir):
    return stats.severities(view.events(spark, sf_dir)).select(F.col("severity").cast("long").alias("severity"), "records")


@query("SELECT count(*) AS records, CAST(0 AS BIGINT) AS parse_errors FROM rec")
def stats_totals(spark, sf_dir):
    return stats.totals(view.all_records(spark, sf_dir))


@query("SELECT count(*) FILTER (tag = 25) AS keyref_redacted, count(*) FILTER (subsystem >= 65280) AS diag_redacted FROM rec")
def stats_redaction_counts(spark, sf_dir):
    return stats.redaction_counts(redact.redact(view.all_records(spark, sf_dir)))


@query("SELECT CAST(tag AS BIGINT) AS tag, record_index, record_index // 72057594037927936 AS section_index, record_index % 72057594037927936 AS record_in_sec FROM rec")
def index_postings(spark, sf_dir):
    return stats.postings(view.all_records(spark, sf_dir)).select(F.col("tag").cast("long").alias("tag"), "record_index", F.col("section_index").cast("long").alias("section_index"), "record_in_sec")


@query("SELECT record_index FROM rec WHERE tag = 25")
def index_lookup(spark, sf_dir):
    return stats.lookup(stats.postings(view.all_records(spark, sf_dir)), TAGS["KEYREF"]).select("record_index")


# ---- timeline ---------------------------------------------------------------------------------------

_SESSIONS = """, s AS (SELECT *, sum(CASE WHEN tag = 16 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY record_index) - 1 AS session FROM
  (SELECT r.*, {stream} AS stream FROM rec r JOIN events e ON r.record_index = e.event_id)),
g AS (SELECT stream, session, max(uptime_s) AS uptime_s, max(seq) AS seq, count(*) AS record_count, min(record_index) AS first_record_index FROM s WHERE session >= 0 GROUP BY ALL),
d AS (SELECT *, uptime_s - lag(uptime_s) OVER (PARTITION BY stream ORDER BY session) AS delta_s FROM g),
t AS (SELECT *, CASE WHEN delta_s < 0 THEN 'ORDERING' WHEN delta_s > {limit} THEN 'GAP' END AS status FROM d)
"""


def _device_events(spark, sf_dir):
    """The event stream with its user as device."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("record_index"), F.col("user_id").alias("device"))
    return view.events(spark, sf_dir).join(users, "record_index")


@query(_SESSIONS.format(stream="e.user_id", limit=172800) + "SELECT stream AS device, CAST(session AS BIGINT) AS session, CAST(uptime_s AS BIGINT) AS uptime_s, CAST(seq AS BIGINT) AS seq, record_count, first_record_index, status FROM t")
def timeline_sessions(spark, sf_dir):
    s = timeline.sessions(_device_events(spark, sf_dir), ("device",), expected_s=86400, tolerance=2)
    return s.select("device", "session", "uptime_s", "seq", "record_count", "first_record_index", "status")


@query(_SESSIONS.format(stream="0", limit=1200) + "SELECT record_count, count(*) AS sessions, count(*) FILTER (status = 'GAP') AS gaps FROM t GROUP BY ALL")
def timeline_gaps(spark, sf_dir):
    """One stream in event order: a single session chain."""
    s = timeline.sessions(view.events(spark, sf_dir), expected_s=600, tolerance=2)
    return s.groupBy("record_count").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("status") == "GAP").alias("gaps"))


@query(_SESSIONS.format(stream="e.user_id", limit=172800) + "SELECT a.stream AS device, count(DISTINCT a.session) FILTER (a.session >= 0) AS sessions, count(*) FILTER (a.session < 0) AS unattributed, max((SELECT count(*) FROM t WHERE t.stream = a.stream AND status = 'GAP')) AS gaps, max((SELECT count(*) FROM t WHERE t.stream = a.stream AND status = 'ORDERING')) AS ordering_violations FROM s a GROUP BY a.stream")
def timeline_summary(spark, sf_dir):
    return timeline.summary(_device_events(spark, sf_dir), ("device",), expected_s=86400, tolerance=2).select("device", "sessions", "gaps", "ordering_violations", "unattributed")


@query(_SESSIONS.format(stream="0", limit=120) + "SELECT count(*) FILTER (session < 0) AS unattributed, count(*) AS records FROM s")
def timeline_unattributed(spark, sf_dir):
    a = timeline.attributed(view.events(spark, sf_dir).select("path", "record_index", "tag"))
    return a.agg(F.count_if(F.col("session").isNull()).alias("unattributed"), F.count(F.lit(1)).alias("records"))


@query(_SESSIONS.format(stream="e.user_id", limit=120) + "SELECT stream AS device, CAST(session AS BIGINT) AS session, type, count(*) AS n FROM s WHERE session >= 0 GROUP BY ALL")
def timeline_tag_counts(spark, sf_dir):
    s = timeline.sessions(_device_events(spark, sf_dir), ("device",))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("type"), F.col(f"n_{n.lower()}").alias("n")) for n in TAGS]))
    return s.select("device", "session", pairs.alias("x")).select("device", "session", "x.type", "x.n").filter("n > 0")


# ---- ranking and sampling ---------------------------------------------------------------------------

_SQL_FIELDS = {
    "heartbeat.uptime_s": "uptime_s", "heartbeat.seq": "seq", "battery.pct": "pct", "battery.temp_c_e1": "temp_c_e1", "battery.cycles": "cycles", "geo.lat_e7": "lat_e7",
    "geo.lon_e7": "lon_e7", "geo.alt_mm": "alt_mm", "net.rx_bytes": "rx_bytes", "net.tx_bytes": "tx_bytes", "net.rx_pkts": "rx_pkts", "net.tx_pkts": "tx_pkts",
    "sensor.sensor_id": "sensor_id", "sensor.count": "len(samples)", "event.code": "code", "event.payload_len": "length(payload)", "log.severity": "severity",
    "config.pair_count": "CASE WHEN v1 IS NOT NULL THEN 2 END", "diag.blob_len": "octet_length(encode(blob))",
}


def _topk(field: str, column: str) -> None:
    @query(f"SELECT CAST({column} AS DOUBLE) AS value, record_index FROM rec WHERE {column} IS NOT NULL ORDER BY value DESC, record_index LIMIT 25", "topk_" + field.replace(".", "_"))
    def run(spark, sf_dir):
        return ranking.topk(view.all_records(spark, sf_dir), field, 25).select("value", "record_index")


for _name, _column in _SQL_FIELDS.items():
    _topk(_name, _column)


@query("SELECT CAST(pct AS DOUBLE) AS value, record_index FROM rec WHERE pct IS NOT NULL")
def topk_all(spark, sf_dir):
    return ranking.topk(view.all_records(spark, sf_dir), "battery.pct").select("value", "record_index")


@query("SELECT unnest([" + ", ".join(f"'{f}'" for f in ranking.FIELDS) + "]) AS field")
def topk_fields(spark, sf_dir):
    return spark.createDataFrame([(f,) for f in ranking.fields()], "field string")


_SAMPLE_SQL = """
WITH RECURSIVE n AS (SELECT count(*) AS n FROM events),
a AS (SELECT 25::BIGINT AS i, NULL::BIGINT AS j, 42::BIGINT AS state UNION ALL
  SELECT CASE WHEN ok THEN i + 1 ELSE i END, CASE WHEN ok THEN x % (i + 1) END, x FROM (
    SELECT i, x, x < 4294967295 - 4294967295 % (i + 1) AS ok FROM (
      SELECT i, xor(s2, (s2 << 5) & 4294967295) AS x FROM (SELECT i, xor(s1, s1 >> 17) AS s2 FROM (SELECT i, xor(state, (state << 13) & 4294967295) AS s1 FROM a, n WHERE i < n.n))))),
w AS (SELECT j, max(i) - 1 AS i FROM a WHERE j < 25 GROUP BY j)
SELECT coalesce(w.i, r.j) AS record_index FROM (SELECT unnest(range(0, 25)) AS j) r LEFT JOIN w ON w.j = r.j
"""


@query(_SAMPLE_SQL)
def sample_n(spark, sf_dir):
    return ranking.sample(view.events(spark, sf_dir), 25, 42).select("record_index")


# ---- sets and comparisons ---------------------------------------------------------------------------

def _coarse(spark, sf_dir):
    """Events without what makes each unique, so that duplicates exist."""
    e = view.events(spark, sf_dir)
    return e.withColumn("battery", F.when(F.col("battery").isNotNull(), F.col("battery").withField("cycles", F.lit(0).cast("long")))).withColumn("net", F.when(F.col("net").isNotNull(), F.col("net").withField("tx_bytes", F.lit(0).cast("long"))))


_COARSE = "concat_ws('|', tag, uptime_s, seq, severity, msg, iface_id, rx_bytes, rx_pkts, tx_pkts, lat_e7, lon_e7, alt_mm, pct, temp_c_e1)"


@query(f"SELECT min(record_index) AS record_index FROM rec WHERE tag IN (16, 20, 21, 22, 23) GROUP BY {_COARSE}")
def dedup_keep_first(spark, sf_dir):
    return compare.dedup(_coarse(spark, sf_dir)).select("record_index")


@query(f"SELECT count(*) - count(DISTINCT {_COARSE}) AS dropped FROM rec WHERE tag IN (16, 20, 21, 22, 23)")
def dedup_dropped(spark, sf_dir):
    return compare.dropped(_coarse(spark, sf_dir))


@query("SELECT min(record_index) AS record_index FROM rec WHERE tag = 25 GROUP BY slot_id")
def dedup_keyref_ignores_label(spark, sf_dir):
    return compare.dedup(view.keyrefs(spark, sf_dir)).select("record_index")


def _changed(spark, sf_dir):
    """The stream with every fifth battery and every seventh position changed, kinds swapped, and the tail cut."""
    e = view.events(spark, sf_dir).filter("record_index % 97 <> 96")
    i = F.col("record_index")
    e = e.withColumn("battery", F.when(F.col("battery").isNotNull() & (i % 5 == 0), F.col("battery").withField("pct", (F.col("battery.pct") + 1).cast("smallint"))).otherwise(F.col("battery")))
    return e.withColumn("geo", F.when(F.col("geo").isNotNull() & (i % 7 == 0), F.col("geo").withField("alt_mm", F.col("geo.alt_mm") + 1)).otherwise(F.col("geo")))


@query("""SELECT record_index, CASE WHEN record_index % 97 = 96 THEN 'only in a (tag ' || type || ')' WHEN tag = 21 THEN 'u.battery.pct ' || pct || ' != ' || (pct + 1)
  ELSE 'u.geo.alt_mm ' || alt_mm || ' != ' || (alt_mm + 1) END AS why FROM rec WHERE record_index < 72057594037927936 AND (record_index % 97 = 96 OR (tag = 21 AND record_index % 5 = 0) OR (tag = 20 AND record_index % 7 = 0))""")
def diff_positional(spark, sf_dir):
    return compare.diff(view.events(spark, sf_dir), _changed(spark, sf_dir))


@query("SELECT record_index, 'only in b (tag ' || type || ')' AS why FROM rec WHERE record_index < 72057594037927936 AND record_index % 97 = 96")
def diff_tail(spark, sf_dir):
    whole = view.events(spark, sf_dir)
    return compare.diff(whole.filter("record_index % 97 <> 96"), whole)


@query("SELECT record_index, NOT ((tag = 21 AND record_index % 5 = 0) OR (tag = 20 AND record_index % 7 = 0)) AS equal FROM rec WHERE record_index < 72057594037927936 AND record_index % 97 <> 96")
def records_equal(spark, sf_dir):
    return compare.records_equal(view.events(spark, sf_dir), _changed(spark, sf_dir))


@query("SELECT CAST(tag AS BIGINT) AS section_index, o AS input_ord, count(*) AS records, min(record_index) AS first, max(record_index) AS last FROM rec, (SELECT unnest([0, 1]) AS o) WHERE record_index < 72057594037927936 OR o = 0 GROUP BY ALL")
def merge_by_tag(spark, sf_dir):
    m = writers.merged([view.all_records(spark, sf_dir), view.events(spark, sf_dir)])
    return m.groupBy(F.col("section_index").cast("long").alias("section_index"), "input_ord").agg(F.count(F.lit(1)).alias("records"), F.min("record_index").alias("first"), F.max("record_index").alias("last"))


@query("SELECT 'split_' || type || '.dtl' AS path, CAST(tag AS BIGINT) AS section_type, count(*) AS records FROM rec GROUP BY ALL")
def split_partition(spark, sf_dir):
    s = writers.split(view.all_records(spark, sf_dir))
    return s.groupBy("path", F.col("section_type").cast("long").alias("section_type")).agg(F.count(F.lit(1)).alias("records"))


# ---- validation and redaction -----------------------------------------------------------------------

_RULES = """, v AS (
SELECT record_index, 'VAL-1' AS rule, 'warning' AS severity, 'heartbeat with seq 0' AS message FROM rec WHERE seq = 0
UNION ALL SELECT record_index, 'VAL-2', 'info', 'sensor record with no samples' FROM rec WHERE len(samples) = 0
UNION ALL SELECT record_index, 'VAL-3', 'warning', 'event 0x' || lpad(lower(to_hex(code)), 4, '0') || ' with empty payload' FROM rec WHERE payload = ''
UNION ALL SELECT record_index, 'VAL-4', 'warning', 'diag subsystem ' || subsystem || ' with empty blob' FROM rec WHERE blob = ''
UNION ALL SELECT record_index, 'VAL-5', 'error', 'latitude ' || lat_e7 || ' out of range' FROM rec WHERE abs(lat_e7) > 900000000
UNION ALL SELECT record_index, 'VAL-6', 'error', 'longitude ' || lon_e7 || ' out of range' FROM rec WHERE abs(lon_e7) > 1800000000
UNION ALL SELECT record_index, 'VAL-7', 'error', 'battery pct ' || pct || ' over 100' FROM rec WHERE pct > 100
UNION ALL SELECT record_index, 'VAL-8', 'warning', 'rx_bytes nonzero with zero rx_pkts' FROM rec WHERE rx_pkts = 0 AND rx_bytes <> 0
UNION ALL SELECT record_index, 'VAL-9', 'warning', 'tx_bytes nonzero with zero tx_pkts' FROM rec WHERE tx_pkts = 0 AND tx_bytes <> 0
UNION ALL SELECT record_index, 'VAL-11', 'info', 'empty log message' FROM rec WHERE msg = ''
UNION ALL SELECT record_index, 'VAL-12', 'error', 'config pair 0 has empty key' FROM rec WHERE k0 = ''
UNION ALL SELECT record_index, 'VAL-13', 'warning', 'keyref references reserved slot 0' FROM rec WHERE slot_id = 0
UNION ALL SELECT record_index, 'VAL-14', 'warning', 'firmware version 0.0.0' FROM rec WHERE major = 0 AND minor = 0 AND patch = 0)
"""


@query(_RULES + "SELECT * FROM v")
def validate_issues(spark, sf_dir):
    return validate.issues(view.all_records(spark, sf_dir)).select("record_index", "rule", "severity", "message")


@query(_RULES + "SELECT (SELECT count(*) FROM rec) AS records, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'FAIL' ELSE 'OK' END AS verdict FROM v")
def validate_summary(spark, sf_dir):
    return validate.summary(view.all_records(spark, sf_dir))


def _redacted(df):
    return df.filter("keyref IS NOT NULL OR diag IS NOT NULL").select("record_index", F.coalesce("keyref.redacted", "diag.redacted").alias("redacted"), F.coalesce(F.length("keyref.label"), F.length("diag.blob")).cast("long").alias("left"))


@query("SELECT record_index, tag = 25 OR subsystem >= 65280 AS redacted, CAST(CASE WHEN tag = 25 OR subsystem >= 65280 THEN 0 ELSE octet_length(encode(blob)) END AS BIGINT) AS left FROM rec WHERE tag IN (19, 25)")
def redact_plain(spark, sf_dir):
    return _redacted(redact.redact(view.all_records(spark, sf_dir)))


@query("SELECT record_index, CASE WHEN tag = 25 THEN slot_id IN (1, 2) ELSE subsystem >= 65280 END AS redacted, CAST(CASE WHEN slot_id IN (1, 2) OR subsystem >= 65280 THEN 0 ELSE octet_length(encode(coalesce(blob, label))) END AS BIGINT) AS left FROM rec WHERE tag IN (19, 25)")
def redact_keystore(spark, sf_dir):
    return _redacted(redact.redact_keystore(view.all_records(spark, sf_dir)))


# ---- text and containers ----------------------------------------------------------------------------

_HEX = "lower(hex(encode({})))"
_C = lambda form, samples: f"list_transform({samples}, lambda x: printf('{form}', CAST(x AS DOUBLE)))"
_CSV = f"""SELECT record_index, record_index || ',' || type || ',' || CASE tag WHEN 17 THEN array_to_string(list_concat([CAST(sensor_id AS VARCHAR), CAST(len(samples) AS VARCHAR)], {_C('%.6g', 'samples[1:4]')}), ',') WHEN 16 THEN uptime_s || ',' || seq || ',,,,' WHEN 18 THEN code || ',' || length(payload) || ',' || {_HEX.format('payload')} || ',,'
  WHEN 19 THEN subsystem || ',' || octet_length(encode(blob)) || ',0,' || {_HEX.format('blob')} || ',,' WHEN 20 THEN lat_e7 || ',' || lon_e7 || ',' || alt_mm || ',,,' WHEN 21 THEN pct || ',' || temp_c_e1 || ',' || cycles || ',,,'
  WHEN 22 THEN iface_id || ',' || rx_bytes || ',' || tx_bytes || ',' || rx_pkts || ',' || tx_pkts || ',' WHEN 23 THEN severity || ',"' || replace(msg, '"', '""') || '",,,'
  WHEN 24 THEN '2,"' || k0 || '","' || v0 || '","type","' || v1 || '"' WHEN 25 THEN slot_id || ',0,"' || label || '",,,' ELSE major || ',' || minor || ',' || patch || ',' || {_HEX.format('hash')} || ',,' END AS line FROM rec"""


@query(_CSV)
def export_csv_rows(spark, sf_dir):
    return writers.csv_lines(view.all_records(spark, sf_dir))


@query(f"""SELECT record_index, '{{"index":' || record_index || ',"tag":' || tag || ',"type":"' || type || '",' || CASE tag WHEN 17 THEN '"sensor_id":' || sensor_id || ',"samples":[' || array_to_string({_C('%.9g', 'samples')}, ',') || ']' WHEN 16 THEN '"uptime_s":' || uptime_s || ',"seq":' || seq
  WHEN 18 THEN '"code":' || code || ',"payload_hex":"' || {_HEX.format('payload')} || '"' WHEN 19 THEN '"subsystem":' || subsystem || ',"redacted":false,"blob_hex":"' || {_HEX.format('blob')} || '"'
  WHEN 20 THEN '"lat_e7":' || lat_e7 || ',"lon_e7":' || lon_e7 || ',"alt_mm":' || alt_mm WHEN 21 THEN '"pct":' || pct || ',"temp_c_e1":' || temp_c_e1 || ',"cycles":' || cycles
  WHEN 22 THEN '"iface_id":' || iface_id || ',"rx_bytes":' || rx_bytes || ',"tx_bytes":' || tx_bytes || ',"rx_pkts":' || rx_pkts || ',"tx_pkts":' || tx_pkts
  WHEN 23 THEN '"severity":' || severity || ',"msg":"' || replace(msg, '"', '\\"') || '"' WHEN 24 THEN '"pairs":{{"' || k0 || '":"' || v0 || '","type":"' || v1 || '"}}'
  WHEN 25 THEN '"slot_id":' || slot_id || ',"redacted":false,"label":"' || label || '"' ELSE '"version":"' || major || '.' || minor || '.' || patch || '","hash_hex":"' || {_HEX.format('hash')} || '"' END || '}}' AS line FROM rec""")
def export_json_rows(spark, sf_dir):
    return writers.json_lines(view.all_records(spark, sf_dir))


_QUOTED = lambda c: f"""'\"' || {c} || '\"'"""
_PRINTED = f"""SELECT record_index, record_index || ' ' || type || CASE tag WHEN 16 THEN ' uptime_s=' || uptime_s || ' seq=' || seq
  WHEN 17 THEN ' sensor_id=' || sensor_id || ' count=' || len(samples) || ' samples=' || array_to_string({_C('%g', 'samples')}, ',')
  WHEN 18 THEN ' code=' || code || ' payload_len=' || length(payload) || ' payload=' || {_HEX.format('payload')}
  WHEN 19 THEN ' subsystem=0x' || lpad(lower(to_hex(subsystem)), 4, '0') || ' blob_len=' || octet_length(encode(blob)) || ' blob=' || {_HEX.format('blob')} || ' redacted=0'
  WHEN 20 THEN ' lat_e7=' || lat_e7 || ' lon_e7=' || lon_e7 || ' alt_mm=' || alt_mm WHEN 21 THEN ' pct=' || pct || ' temp_c_e1=' || temp_c_e1 || ' cycles=' || cycles
  WHEN 22 THEN ' iface_id=' || iface_id || CASE WHEN iface_id >= 128 THEN '/ext' ELSE '/int' END || ' rx_bytes=' || rx_bytes || ' tx_bytes=' || tx_bytes || ' rx_pkts=' || rx_pkts || ' tx_pkts=' || tx_pkts
  WHEN 23 THEN ' severity=' || severity || ' msg_len=' || length(msg) || ' msg=' || {_QUOTED('msg')} WHEN 24 THEN ' pair_count=2 ' || k0 || '=' || v0 || ' type=' || v1
  WHEN 25 THEN ' slot_id=' || slot_id || ' label_len=' || length(label) || ' label=' || {_QUOTED('label')} || ' redacted=0'
  ELSE ' major=' || major || ' minor=' || minor || ' patch=' || patch || ' hash=' || {_HEX.format('hash')} END AS line FROM rec"""


@query(_PRINTED)
def decode_lines(spark, sf_dir):
    return writers.printed_lines(view.all_records(spark, sf_dir))


_SIX = "len(list_filter(samples[1:4], lambda x: CAST(printf('%.6g', CAST(x AS DOUBLE)) AS FLOAT) <> x)) = 0"


@query(f"SELECT record_index, CASE WHEN tag = 17 THEN {_SIX} ELSE true END AS equal FROM rec", chunk=500)
def import_csv_roundtrip(spark, sf_dir):
    """Texts in chunks that a CSV field can hold; of samples CSV keeps four, with six digits."""
    r = view.all_records(spark, sf_dir, chunk=500)
    r = r.withColumn("sensor", F.when(F.col("sensor").isNotNull(), F.col("sensor").withField("samples", F.slice("sensor.samples", 1, 4))))
    return compare.records_equal(r, readers.parse_rows(writers.csv_lines(r), "csv"), missing=True)


@query("SELECT record_index, true AS equal FROM rec")
def import_json_roundtrip(spark, sf_dir):
    r = view.all_records(spark, sf_dir)
    return compare.records_equal(r, readers.parse_rows(writers.json_lines(r), "json"), missing=True)


@query("SELECT DISTINCT CAST(tag AS BIGINT) AS tag, type AS name, CAST(tag AS BIGINT) AS back FROM rec")
def scalar_tag_names(spark, sf_dir):
    t = view.all_records(spark, sf_dir).select("tag").distinct().withColumn("name", tag_name(F.col("tag")))
    return t.select(F.col("tag").cast("long").alias("tag"), "name", name_tag(F.lower("name"), fold_case=True).cast("long").alias("back"))


@query("SELECT p_partkey, lower(hex(encode(p_brand))) AS hexed, CAST(p_size AS BIGINT) AS major, CAST(0 AS BIGINT) AS minor, CAST(p_partkey % 65536 AS BIGINT) AS patch FROM part")
def scalar_hex_and_version(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    h = text.hex_text(F.col("p_brand").cast("binary"))
    v = text.version_parts(F.concat_ws(".", "p_size", F.lit(0), F.col("p_partkey") % 65536))
    return p.select("p_partkey", text.hex_text(text.hex_bytes(h)).alias("hexed"), *[x.cast("long").alias(n) for x, n in zip(v, ("major", "minor", "patch"))])


def queries() -> dict:
    from . import file_queries  # noqa: F401  (registers its queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import file_queries  # noqa: F401

    return dict(SQL)
