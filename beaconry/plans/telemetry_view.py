"""The driver's tables as telemetry records, in Spark and as a SQL prefix for the oracle.

Each table is a block; a record's index is its block and its key within the block, so indexes are unique and
ordered without a global window. Events are block 0, and their index is the event id. A document is one DIAG
record for every ``CHUNK`` characters of its whole text (a payload has at most 65,535 bytes), an embedding one
SENSOR record of all its values; every seventh document and every fifth vector adds an empty record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import KINDS, NAMES, TAGS

BLOCK = 1 << 56
#: Characters of a text in one record: four bytes each stay below the format's limit.
CHUNK = 16_000
#: Place of a document's empty record, behind all of its chunks.
EMPTY = 65_535
COLUMNS = ["path", "section_index", "section_type", "codec_id", "record_in_sec", "record_index", "tag", "type", *KINDS]


_NAME = "case {} " + " ".join(f"when {t} then '{n}'" for t, n in NAMES.items()) + " end"


def records(df: DataFrame, path: str, block: int, key: str, kinds: dict[str, str], tag: str | None = None) -> DataFrame:
    """``df``'s rows as records; key and kinds are SQL, the kinds structs of which one is set per row."""
    tag = tag or str(TAGS[next(iter(kinds)).upper()])
    return df.selectExpr(
        f"'{path}' as path", f"{block} as section_index", "1 as section_type", "0S as codec_id", f"cast({key} as bigint) as record_in_sec", f"cast({block * BLOCK} + {key} as bigint) as record_index",
        f"cast({tag} as smallint) as tag", f"{_NAME.format(tag)} as type", *[f"cast({kinds.get(k, 'null')} as {ddl}) as {k}" for k, ddl in KINDS.items()],
    )


def struct(**fields: str) -> str:
    return f"named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())})"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = "cast(get_json_object(props, '$.k') as bigint)"
    start = "timestamp_ntz'2024-01-01 00:00:00'" if dict(e.dtypes)["ts"] == "timestamp_ntz" else "timestamp'2024-01-01 00:00:00'"
    at = lambda kind, s: f"case when event_type = '{kind}' then {s} end"
    kinds = {
        "heartbeat": at("signup", struct(uptime_s=f"timestampdiff(SECOND, {start}, ts)", seq="event_id % 500")),
        "log": at("error", struct(severity=f"{k} % 8", msg=f"cast(case when {k} % 11 = 0 then '' else props end as binary)")),
        "net": at("click", struct(iface_id="user_id % 250", rx_bytes="cast(round(value * 100) as bigint)", tx_bytes="event_id % 4294967296", rx_pkts=f"{k} % 5", tx_pkts=f"{k} % 3")),
        "geo": at("view", struct(lat_e7=f"({k} - 50) * 20000000", lon_e7="(user_id % 151 - 75) * 25000000", alt_mm="cast(round(value * 100) as bigint)")),
        "battery": at("purchase", struct(pct=f"{k} + 20", temp_c_e1=f"{k} - 40", cycles="user_id")),
    }
    names = (("signup", "HEARTBEAT"), ("error", "LOG"), ("click", "NET"), ("view", "GEO"), ("purchase", "BATTERY"))
    return records(e, "events", 0, "event_id", kinds, f"case event_type {' '.join(f"when '{kind}' then {TAGS[name]}" for kind, name in names)} end")


def sensors(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = e.withColumn("empty", F.explode(F.expr("if(vec_id % 5 = 0, array(0, 1), array(0))")))
    samples = "if(empty = 1, cast(array() as array<float>), coalesce(embedding, cast(array() as array<float>)))"
    return records(e, "embeddings", 1, "(vec_id * 2 + empty)", {"sensor": struct(sensor_id="label", samples=samples)})


def configs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/part.parquet")
    pair = "named_struct('key', cast({} as binary), 'value', cast({} as binary))"
    pairs = f"array({pair.format("case when p_size % 10 = 0 then '' else 'brand' end", 'p_brand')}, {pair.format("'type'", 'p_type')})"
    return records(e, "part", 2, "p_partkey", {"config": struct(pairs=pairs)})


def event_codes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return records(e, "orders", 3, "o_orderkey", {"event": struct(code="o_custkey % 65536", payload="cast(case when o_custkey % 10 = 0 then '' else o_orderpriority end as binary)")})


def diags(spark, sf_dir, chunk=CHUNK):
    e = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = f"sequence(0, cast(greatest(ceil(coalesce(length(text), 0) / {chunk}), 1) - 1 as int))"
    e = e.withColumn("part", F.explode(F.expr(f"if(doc_id % 7 = 0, array_append({parts}, {EMPTY}), {parts})")))
    blob = f"cast(if(part = {EMPTY}, '', substring(coalesce(text, ''), part * {chunk} + 1, {chunk})) as binary)"
    return records(e, "documents", 4, "(doc_id * 65536 + part)", {"diag": struct(subsystem="case when lang = 'en' then 0 else 65280 end + doc_id % 256", blob=blob, redacted="false")})


def keyrefs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return records(e, "supplier", 5, "s_suppkey", {"keyref": struct(slot_id="s_suppkey % 8", label="cast(s_name as binary)", redacted="false")})


def firmwares(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return records(e, "nation", 6, "n_nationkey", {"firmware": struct(major="n_regionkey", minor="n_nationkey", patch="n_nationkey % 3", hash="cast(rpad(left(n_name, 8), 8, ' ') as binary)")})


def all_records(spark: SparkSession, sf_dir: str, chunk: int = CHUNK) -> DataFrame:
    out = events(spark, sf_dir).unionByName(diags(spark, sf_dir, chunk))
    for part in (sensors, configs, event_codes, keyrefs, firmwares):
        out = out.unionByName(part(spark, sf_dir))
    return out


def sql(chunk: int = CHUNK) -> str:
    """The same records, flat, as common table expressions that end with ``rec``."""
    return f"""
WITH ev AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
flat AS (
SELECT event_id AS record_index, CASE event_type WHEN 'signup' THEN 16 WHEN 'error' THEN 23 WHEN 'click' THEN 22 WHEN 'view' THEN 20 WHEN 'purchase' THEN 21 END AS tag,
  CASE WHEN event_type = 'signup' THEN CAST(floor(epoch(ts) - 1704067200) AS BIGINT) END AS uptime_s, CASE WHEN event_type = 'signup' THEN event_id % 500 END AS seq,
  CASE WHEN event_type = 'error' THEN k % 8 END AS severity, CASE WHEN event_type = 'error' THEN CASE WHEN k % 11 = 0 THEN '' ELSE props END END AS msg,
  CASE WHEN event_type = 'click' THEN user_id % 250 END AS iface_id, CASE WHEN event_type = 'click' THEN CAST(round(value * 100) AS BIGINT) END AS rx_bytes,
  CASE WHEN event_type = 'click' THEN event_id % 4294967296 END AS tx_bytes, CASE WHEN event_type = 'click' THEN k % 5 END AS rx_pkts, CASE WHEN event_type = 'click' THEN k % 3 END AS tx_pkts,
  CASE WHEN event_type = 'view' THEN (k - 50) * 20000000 END AS lat_e7, CASE WHEN event_type = 'view' THEN (user_id % 151 - 75) * 25000000 END AS lon_e7, CASE WHEN event_type = 'view' THEN CAST(round(value * 100) AS BIGINT) END AS alt_mm,
  CASE WHEN event_type = 'purchase' THEN k + 20 END AS pct, CASE WHEN event_type = 'purchase' THEN k - 40 END AS temp_c_e1, CASE WHEN event_type = 'purchase' THEN user_id END AS cycles,
  NULL::BIGINT AS sensor_id, NULL::FLOAT[] AS samples, NULL::VARCHAR AS k0, NULL::VARCHAR AS v0, NULL::VARCHAR AS v1, NULL::BIGINT AS code, NULL::VARCHAR AS payload, NULL::BIGINT AS subsystem, NULL::VARCHAR AS blob,
  NULL::BIGINT AS slot_id, NULL::VARCHAR AS label, NULL::BIGINT AS major, NULL::BIGINT AS minor, NULL::BIGINT AS patch, NULL::VARCHAR AS hash FROM ev
UNION ALL BY NAME SELECT {BLOCK} + vec_id * 2 + e AS record_index, 17 AS tag, CAST(label AS BIGINT) AS sensor_id, CASE WHEN e = 1 THEN [] ELSE coalesce(embedding, []) END AS samples
  FROM (SELECT *, unnest(CASE WHEN vec_id % 5 = 0 THEN [0, 1] ELSE [0] END) AS e FROM embeddings)
UNION ALL BY NAME SELECT {2 * BLOCK} + p_partkey AS record_index, 24 AS tag, CASE WHEN p_size % 10 = 0 THEN '' ELSE 'brand' END AS k0, p_brand AS v0, p_type AS v1 FROM part
UNION ALL BY NAME SELECT {3 * BLOCK} + o_orderkey AS record_index, 18 AS tag, o_custkey % 65536 AS code, CASE WHEN o_custkey % 10 = 0 THEN '' ELSE o_orderpriority END AS payload FROM orders
UNION ALL BY NAME SELECT {4 * BLOCK} + doc_id * 65536 + p AS record_index, 19 AS tag, CASE WHEN lang = 'en' THEN 0 ELSE 65280 END + doc_id % 256 AS subsystem,
  CASE WHEN p = {EMPTY} THEN '' ELSE substr(coalesce(text, ''), p * {chunk} + 1, {chunk}) END AS blob
  FROM (SELECT *, unnest(list_concat(range(0, greatest((coalesce(length(text), 0) + {chunk - 1}) // {chunk}, 1)), CASE WHEN doc_id % 7 = 0 THEN [{EMPTY}] ELSE [] END)) AS p FROM documents)
UNION ALL BY NAME SELECT {5 * BLOCK} + s_suppkey AS record_index, 25 AS tag, s_suppkey % 8 AS slot_id, s_name AS label FROM supplier
UNION ALL BY NAME SELECT {6 * BLOCK} + n_nationkey AS record_index, 26 AS tag, CAST(n_regionkey AS BIGINT) AS major, CAST(n_nationkey AS BIGINT) AS minor, CAST(n_nationkey % 3 AS BIGINT) AS patch, rpad(left(n_name, 8), 8, ' ') AS hash FROM nation),
rec AS (SELECT *, CASE tag {' '.join(f"WHEN {t} THEN '{n}'" for n, t in TAGS.items())} END AS type FROM flat)
"""
