"""A synthetic corpus: one deterministic container per seed, nine records in three sections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wire
from ..functions.schema import TAGS
from . import writers


def _wrap(x: int, bits: int, signed: bool = False) -> int:
    x %= 1 << bits
    return x - (1 << bits) if signed and x >> bits - 1 else x


def corpus_sections(seed: int) -> list[tuple[int, int, list[dict]]]:
    """Section type, codec and records of ``seed`` (an unsigned 32-bit number)."""
    # What each record holds as a function of the seed.
    byte = lambda first, n: bytes(_wrap(first + i, 8) for i in range(n))
    record = lambda kind, **body: {"tag": TAGS[kind.upper()], kind: body}
    degrees = _wrap(seed * 1000, 32, True)
    pairs = {"mode": "standby" if seed % 2 else "active", "index": str(seed)}
    return [
        (1, 0, [
            record("heartbeat", uptime_s=_wrap(seed * 100, 32), seq=_wrap(seed * 7 + 1, 32)),
            record("geo", lat_e7=degrees, lon_e7=_wrap(-degrees, 32, True), alt_mm=_wrap(seed, 32, True)),
            record("battery", pct=seed % 100, temp_c_e1=_wrap(seed * 3 - 100, 16, True), cycles=_wrap(seed * 11, 32)),
        ]),
        (2, 3, [
            record("keyref", slot_id=seed % 8, label=f"device-key-slot-{seed}".encode(), redacted=False),
            record("diag", subsystem=0xFF00, blob=byte(0x40 + seed, 8), redacted=False),
            record("event", code=_wrap(seed * 13, 16), payload=byte(seed, 4)),
        ]),
        (3, 4, [
            record("log", severity=seed % 8, msg=f"corpus record seed={seed}".encode()),
            record("config", pairs=[{"key": k.encode(), "value": v.encode()} for k, v in pairs.items()]),
            record("sensor", sensor_id=_wrap(seed, 16), samples=[float(np.float32(1.5) * np.float32(seed)), -2.5]),
        ]),
    ]


def corpus_container(seed: int) -> bytes:
    return wire.build_container([(kind, codec, b"".join(wire.frame(r["tag"], wire.pack_payload(r)) for r in records)) for kind, codec, records in corpus_sections(seed)])


def generate(spark: SparkSession, first: int, count: int, name: str = "corpus_{seed}.dtl") -> DataFrame:
    """``path, content`` of ``count`` containers, seeds from ``first`` on; write with ``writers.write_files``."""

    def run(batches):
        for batch in batches:
            seeds = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([name.format(seed=s) for s in seeds]), pa.array(map(corpus_container, seeds), pa.binary())], ["path", "content"])

    return spark.range(first, first + count).select(F.col("id")).mapInArrow(run, "path string, content binary")


def write_corpus(spark: SparkSession, first: int, count: int, folder: str) -> int:
    return writers.write_files(generate(spark, first, count), folder)
