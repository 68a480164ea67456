"""Sources: containers, CSV and JSON files as records and errors.

Files are Spark's ``binaryFile`` rows, so any store that Spark reads will do, and decoding runs in
Arrow batches, one file per task step. A file is at most ``max_file`` bytes by the formats' own limit, so
ordinals within it are assigned by its decoder, and no window over all data is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import rows, wire
from ..functions.schema import NAMES, RECORD_DDL, TelemetryError

MAX_FILE = 16 << 20


@dataclass(frozen=True)
class Scan:
    """``records`` and ``errors`` of a lenient read; both decode when they are used."""

    records: DataFrame
    errors: DataFrame


def _files(spark: SparkSession, paths) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("binaryFile").load(paths).select("path", "length", "content")


def record_schema() -> StructType:
    return StructType.fromDDL(RECORD_DDL)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as columns; a kind's structs are built for the rows that have one only, and spread by their places."""
    columns = []
    for f in schema:
        values = [r.get(f.name) for r in rows]
        if pa.types.is_struct(f.type):
            places, own = [None] * len(values), []
            for i, v in enumerate(values):
                if v is not None:
                    places[i] = len(own)
                    own.append(v)
            columns.append(pa.array(own, f.type).take(pa.array(places, pa.int64())) if own else pa.nulls(len(values), f.type))
        else:
            columns.append(pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _rows(path: str, events):
    for kind, at, *rest in events:
        if kind == "record":
            yield {"path": path, **at, "type": NAMES[rest[0]["tag"]], **rest[0]}
        else:
            yield {"path": path, **at, "error": rest[0], "fatal": rest[1]}


def _decode(batches, schema: pa.Schema, parse, mode: str, max_file: int):
    for batch in batches:
        for path, length, content in zip(*(batch.column(i) for i in range(3))):
            path, out = path.as_py(), []
            try:
                if length.as_py() > max_file:
                    raise TelemetryError("RANGE", path)
                for row in _rows(path, parse(content.as_py())):
                    out.append(row)
                    if len(out) >= 10_000:
                        yield _batch(out, schema)
                        out = []
            except TelemetryError as e:
                if mode == "failfast":
                    raise TelemetryError(e.code, path) from e
                out.append({"path": path, "error": e.code, "fatal": True})  # the rest of the file
            if out:
                yield _batch(out, schema)


def _scan(spark, paths, parse, mode: str, max_file: int, keep: bool = False) -> Scan:
    schema = StructType.fromDDL(RECORD_DDL + ", error string, fatal boolean")
    arrow = to_arrow_schema(schema)
    both = _files(spark, paths).mapInArrow(lambda b: _decode(b, arrow, parse, mode, max_file), schema)
    if keep:
        both = both.persist()
    names = record_schema().names
    return Scan(both.filter("error IS NULL").select(*names), both.filter("error IS NOT NULL").select("path", "section_index", "record_in_sec", "error", "fatal"))


def read_dtl(spark: SparkSession, paths, mode: str = "permissive", max_decode: int = wire.WALK_CAP, max_file: int = MAX_FILE, keep: bool = False) -> Scan:
    """Containers. ``permissive`` reports faults and goes on, ``stop`` ends a file at its first fault, ``failfast`` fails the job.

    ``keep`` decodes once for several uses: what was decoded stays in memory or on disk.
    """
    if mode not in ("permissive", "stop", "failfast"):
        raise TelemetryError("INVAL", mode)
    return _scan(spark, paths, (lambda data: wire.walk(data, max_decode)) if mode == "permissive" else wire.scan_strict, mode, max_file, keep)


def _imported(records):
    for i, record in enumerate(records):
        yield "record", {"section_index": 0, "section_type": 1, "codec_id": 0, "record_in_sec": i, "record_index": i}, record


def read_csv(spark: SparkSession, paths, max_file: int = MAX_FILE) -> DataFrame:
    """CSV exports; a malformed line fails the job."""
    return _scan(spark, paths, lambda data: _imported(rows.csv_document(data)), "failfast", max_file).records


def read_json(spark: SparkSession, paths, max_file: int = MAX_FILE) -> DataFrame:
    """JSON exports; a malformed document fails the job."""
    return _scan(spark, paths, lambda data: _imported(rows.json_document(data)), "failfast", max_file).records


def _headers(spark: SparkSession, paths, ddl: str, rows) -> DataFrame:
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(2)):
                c = wire.parse_container(content.as_py())
                head = {"path": path, "version": c["version"], "flags": c["flags"], "has_mac": c["mac"] is not None, "sections": len(c["sections"])}
                yield _batch(rows(head, c["sections"]), arrow)

    return _files(spark, paths).mapInArrow(read, schema)


def read_headers(spark: SparkSession, paths) -> DataFrame:
    """One row per container, also of those without sections."""
    return _headers(spark, paths, "path string, version int, flags int, has_mac boolean, sections int", lambda head, _: [head])


def read_sections(spark: SparkSession, paths) -> DataFrame:
    """The section tables, without decoding: a row per section, and the header's fields with each."""
    ddl = "path string, version int, flags int, has_mac boolean, section_index int, section_type int, codec_id int, raw_len long, comp_len long, offset long"
    return _headers(spark, paths, ddl, lambda head, sections: [head | s | {"section_index": i, "section_type": s["type"]} for i, s in enumerate(sections)])


def verify(spark: SparkSession, paths, key: bytes | None = None) -> DataFrame:
    """``path, verdict`` of each container's keyed checksum."""

    def check(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([wire.verify(c.as_py(), key) for c in batch.column(2)])], ["path", "verdict"])

    return _files(spark, paths).mapInArrow(check, "path string, verdict string")


def visit(records: DataFrame, call, order=("path", "record_index")) -> None:
    """Call ``call`` with each record, a dict, inside the tasks: a file's records in order, in one task.

    A call that returns False or raises ends the job. For entries of the tag index, visit what ``stats.lookup`` returns.
    """

    def run(rows):
        for row in rows:
            if call(row.asDict(recursive=True)) is False:
                raise TelemetryError("INVAL", "stopped by the callback")

    records.repartition(order[0]).sortWithinPartitions(*order).foreachPartition(run)


def parse_rows(lines: DataFrame, form: str, line: str = "line", index: str = "record_index") -> DataFrame:
    """Rows of text (one record each) as records that keep ``index``: the distributed import."""
    schema = record_schema()
    arrow = to_arrow_schema(schema)
    parse = (lambda t: rows.csv_record(rows.csv_fields(t.encode()))) if form == "csv" else (lambda t: rows.json_document(b"[" + t.encode() + b"]")[0])

    def run(batches):
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = parse(text)
                out.append({"path": form, "section_index": 0, "section_type": 1, "codec_id": 0, "record_in_sec": i, "record_index": i, "type": NAMES[r["tag"]], **r})
            yield _batch(out, arrow)

    return lines.select(F.col(index), F.col(line)).mapInArrow(run, schema)
