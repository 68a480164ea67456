"""Sessions by heartbeat over an unbounded record stream, one state per device.

State is the open session of a device; a session is emitted when the next heartbeat closes it, with the
same columns as the batch timeline's. Records of a device must arrive in order within a micro-batch's
index; ties and late records join the session that is open when they come.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.schema import TAGS

OUTPUT = "device long, session long, uptime_s long, seq long, record_count long, first_record_index long"
STATE = "session long, uptime_s long, seq long, record_count long, first_record_index long"


def read_containers(spark: SparkSession, folder: str) -> DataFrame:
    """New container files of a folder as a stream of ``path, modificationTime, length, content``."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)


def _step(key, frames, state: GroupState):
    open_ = list(state.get) if state.exists else None
    rows = pd.concat(list(frames)).sort_values("record_index", kind="stable")
    out = []
    for r in rows.itertuples():
        if r.tag == TAGS["HEARTBEAT"]:
            if open_ is not None:
                out.append((key[0], *open_))
            open_ = [open_[0] + 1 if open_ is not None else 0, int(r.uptime_s), int(r.seq), 1, int(r.record_index)]
        elif open_ is not None:
            open_[3] += 1
    if open_ is not None:
        state.update(tuple(open_))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def closed_sessions(records: DataFrame) -> DataFrame:
    """``records``: device, record_index, tag, uptime_s, seq (the last two null but on heartbeats)."""
    return records.groupBy("device").applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
