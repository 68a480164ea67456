"""Top-k by a named field and the deterministic reservoir sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import TelemetryError

# The fields that rank, by name.
FIELDS = {
    "heartbeat.uptime_s": "heartbeat.uptime_s", "heartbeat.seq": "heartbeat.seq", "battery.pct": "battery.pct", "battery.temp_c_e1": "battery.temp_c_e1",
    "battery.cycles": "battery.cycles", "geo.lat_e7": "geo.lat_e7", "geo.lon_e7": "geo.lon_e7", "geo.alt_mm": "geo.alt_mm", "net.rx_bytes": "net.rx_bytes",
    "net.tx_bytes": "net.tx_bytes", "net.rx_pkts": "net.rx_pkts", "net.tx_pkts": "net.tx_pkts", "sensor.sensor_id": "sensor.sensor_id",
    "sensor.count": "if(sensor is null, null, size(sensor.samples))", "event.code": "event.code", "event.payload_len": "length(event.payload)",
    "log.severity": "log.severity", "config.pair_count": "if(config is null, null, size(config.pairs))", "diag.blob_len": "length(diag.blob)",
}


def fields() -> list[str]:
    return list(FIELDS)


def candidates(records: DataFrame, field: str) -> DataFrame:
    """``value`` and the record's place, of every record that has the field."""
    if field not in FIELDS:
        raise TelemetryError("INVAL", field)
    value = F.expr(FIELDS[field]).cast("double")
    return records.select(value.alias("value"), "path", "type", "section_index", "record_in_sec", "record_index").filter("value IS NOT NULL")


def topk(records: DataFrame, field: str, n: int = 0) -> DataFrame:
    """The n largest (0: all), ties in wire order; a bounded heap per task, never a full sort when n is given."""
    ranked = candidates(records, field).orderBy(F.desc("value"), "path", "record_index")
    return ranked.limit(n) if n else ranked


# The shifts of the reservoir's 32-bit generator and the stand-in of a zero seed.
_SHIFTS, _ZERO_SEED = (13, 17, 5), 0x9E3779B9
_MOST = 0xFFFFFFFF
#: Lanes of the vectorised generator, and steps of each in one block.
LANES, STEPS = 1024, 1024


def _step(x: np.ndarray) -> np.ndarray:
    a, b, c = (np.uint32(n) for n in _SHIFTS)
    x = x ^ (x << a)
    x = x ^ (x >> b)
    return x ^ (x << c)


def _times(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map over bits, given by the images of the 32 single bits, applied to every number of ``x``."""
    out = np.zeros_like(x)
    for i in range(32):
        out ^= np.where(x >> np.uint32(i) & np.uint32(1), columns[i], np.uint32(0))
    return out


def _draws(seed: int, lanes: int, steps: int):
    """Blocks of the generator's stream: a step is linear over bits, so every lane starts where the one before it ends."""
    jump = _step(np.uint32(1) << np.arange(32, dtype=np.uint32))
    for _ in range(steps.bit_length() - 1):  # steps is a power of two
        jump = _times(jump, jump)
    x = np.array([seed & 0xFFFFFFFF or _ZERO_SEED], np.uint32)
    while True:
        starts, ahead = x[-1:], jump
        while len(starts) < lanes:
            starts, ahead = np.concatenate([starts, _times(ahead, starts)]), _times(ahead, ahead)
        block, x = np.empty((steps, lanes), np.uint32), starts
        for i in range(steps):
            x = _step(x)
            block[i] = x
        yield block.T.ravel().astype(np.int64)


def reservoir(total: int, n: int, seed: int, lanes: int = LANES, steps: int = STEPS) -> np.ndarray:
    """The ordinals, ascending, that a reservoir of n keeps of 0..total-1; all when n is 0 or not below total.

    Draws at or above the largest multiple of the bound are thrown away, which shifts all later draws; how many come
    before each draw is found by repeating the count until it stands still.
    """
    if n == 0 or n >= total:
        return np.arange(total)
    if total > _MOST:
        raise TelemetryError("RANGE", f"{total} records; the generator's draws have 32 bits, use sample_hashed")
    held, at = np.arange(n), n
    for draws in _draws(seed, lanes, steps):
        gone = np.zeros(len(draws), np.int64)  # draws thrown away before each
        while True:
            bound = at + 1 + np.arange(len(draws)) - gone
            out = draws >= _MOST - _MOST % bound
            now = np.cumsum(out) - out
            if (now == gone).all():
                break
            gone = now
        used = ~out & (bound <= total)
        slot, ordinal = draws[used] % bound[used], bound[used] - 1
        hit = slot < n
        slot, ordinal = slot[hit][::-1], ordinal[hit][::-1]
        last, first = np.unique(slot, return_index=True)  # the latest of each slot
        held[last] = ordinal[first]
        at += int((~out).sum())
        if at >= total:
            return np.sort(held)
    return held


def sample(records: DataFrame, n: int, seed: int, order="record_index") -> DataFrame:
    """The reservoir's records of one stream whose ``order`` is its dense ordinal from 0.

    The draw depends on the count alone; the ordinals are joined, broadcast while few enough for it.
    """
    total = records.count()
    if n == 0 or n >= total:
        return records
    spark = records.sparkSession
    chosen = spark.createDataFrame([(int(i),) for i in reservoir(total, n, seed)], f"{order} long")
    return records.join(F.broadcast(chosen) if n <= 1_000_000 else chosen, order, "left_semi")


def sample_hashed(records: DataFrame, n: int, seed: int, order=("path", "record_index")) -> DataFrame:
    """n records by the smallest hash of seed and place: any size of stream, a bounded heap per task, the same for any partitioning."""
    return records.orderBy(F.xxhash64(F.lit(seed), *order), *order).limit(n) if n else records
