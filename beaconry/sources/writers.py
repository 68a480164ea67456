"""Sinks: containers, CSV and JSON text, and Parquet split by kind.

A container is built where its rows are grouped, one group per output file; the format bounds it. Records are
framed in Arrow batches before the shuffle, so what moves are compact bytes.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, wire
from ..functions.schema import KINDS, TelemetryError


def framed(records: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``frame``: each record's bytes as they stand in a section."""
    schema = records.select(*keep).schema.add("frame", "binary")

    def run(batches):
        for batch in batches:
            rows = batch.select(["tag", *KINDS]).to_pylist()
            frames = [wire.frame(r["tag"], wire.pack_payload(r)) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(frames, pa.binary())], schema.names)

    return records.select(*dict.fromkeys([*keep, "tag", *KINDS])).mapInArrow(run, schema)


def containers(records: DataFrame, order=("record_in_sec",), codec: int | None = None, key: bytes | None = None) -> DataFrame:
    """``path, content``: a container per path. Sections follow section_index, records ``order`` within them.

    ``codec`` replaces every section's codec, ``key`` signs.
    """
    if key is not None and not key:
        raise TelemetryError("INVAL", "empty key")
    if codec is not None and codec not in wire.codecs.CODECS:
        raise TelemetryError("INVAL", f"codec {codec}")

    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["section_index", *order], kind="stable")
        sections = [(int(g["section_type"].iloc[0]), int(g["codec_id"].iloc[0]) if codec is None else codec, b"".join(g["frame"])) for _, g in f.groupby("section_index", sort=True)]
        return pd.DataFrame({"path": [f["path"].iloc[0]], "content": [wire.build_container(sections, key)]})

    keep = dict.fromkeys(["path", "section_index", "section_type", "codec_id", *order])
    return framed(records, *keep).groupBy("path").applyInPandas(build, "path string, content binary")


def write_files(rows: DataFrame, folder: str) -> int:
    """Write each ``path, content`` as a file of ``folder`` (a URI or a shared path), from the executors.

    A file appears under its name only when it is whole. Returns the number of files.
    """
    uri = folder if "://" in folder else f"file://{folder}"

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = f"{root}/{path.rsplit('/', 1)[-1]}"
                part = f"{name}.{pa.compute.random(1)[0].as_py():.17f}.part"
                with store.open_output_stream(part) as out:
                    out.write(content.as_py())
                store.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    import pyarrow.compute  # noqa: F401

    return rows.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def repack(records: DataFrame, codec: int) -> DataFrame:
    """Containers of the same sections under another codec."""
    return containers(records, codec=codec)


def sign(records: DataFrame, key: bytes) -> DataFrame:
    """Containers of the same sections with a keyed checksum."""
    return containers(records, key=key)


def merged(inputs: list[DataFrame], path: str = "merged.dtl") -> DataFrame:
    """All inputs' records in one stream: by tag, within a tag by input and wire order; a stored section per tag.

    ``input_ord`` says which input a record is from; write with ``containers(..., order=("input_ord", "record_index"))``.
    """
    out = None
    for i, df in enumerate(inputs):
        part = df.withColumn("input_ord", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return _by_tag(out, F.lit(path))


def _by_tag(records: DataFrame, path: Column) -> DataFrame:
    return records.withColumns({"path": path, "section_index": F.col("tag").cast("int"), "section_type": F.col("tag").cast("int"), "codec_id": F.lit(0).cast("smallint")})


def split(records: DataFrame, prefix: str = "split") -> DataFrame:
    """The records under one path per kind, ``prefix_KIND.dtl``, each a stored section; order kept."""
    return _by_tag(records, F.concat(F.lit(prefix + "_"), F.col("type"), F.lit(".dtl")))


def write_split(records: DataFrame, folder: str) -> None:
    """Parquet with one folder per kind: later reads of a kind touch its folder only."""
    records.write.partitionBy("type").parquet(folder)


def csv_lines(records: DataFrame, index: str = "record_index") -> DataFrame:
    return records.select(F.col(index).alias("record_index"), text.csv_row(F.col(index)).alias("line"))


def json_lines(records: DataFrame, index: str = "record_index") -> DataFrame:
    return records.select(F.col(index).alias("record_index"), text.json_row(F.col(index)).alias("line"))


def printed_lines(records: DataFrame, index: str = "record_index") -> DataFrame:
    return records.select(F.col(index).alias("record_index"), text.printed(F.col(index)).alias("line"))


def export(records: DataFrame, form: str, folder: str) -> None:
    """Text files of rows in ``path, record_index`` order: CSV lines (no header) or JSON lines."""
    rows = (csv_lines if text.parse_format(form) == "csv" else json_lines)(records.orderBy("path", "record_index"))
    rows.select("line").write.text(folder)


def document(lines: DataFrame, form: str) -> str:
    """The export of one container as one text, as the reference format frames it (driver side)."""
    rows = [r["line"] for r in lines.orderBy("record_index").collect()]
    if text.parse_format(form) == "csv":
        return "".join(f"{x}\n" for x in (text.CSV_HEADER, *rows))
    return "[" + ",".join(f"\n  {x}" for x in rows) + "\n]\n"
