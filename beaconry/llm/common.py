"""What the operators share: shared storage, column naming and word patterns.

Lineage is cut by writing a Parquet table into the folder that ``spark.checkpoint.dir`` names, so
that every executor can read it and a lost executor loses nothing.
"""

from __future__ import annotations

import ctypes
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, new_folder

#: Blanks as the contracts define them: space and \t \n \v \f \r.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: Rows of texts that travel to a worker and back at once: a batch is held by the JVM, beside its heap, and by the worker.
TEXT_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Stash:
    """Tables written into the shared folder. ``drop`` removes them, at the latest when the driver ends."""

    live: list["Stash"] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = new_folder(spark)
        self.count = 0
        Stash.live.append(self)

    def place(self) -> str:
        """The path of a new table."""
        self.count += 1
        return f"{self.root}/{self.count}"

    def put(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Write ``df`` once and read it back: a plan without history. rows: of an Arrow batch at most, while it is written."""
        path = self.place()
        with _batches_of(df.sparkSession, rows):
            df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._stash_path = path
        return back

    def forget(self, *tables: DataFrame) -> None:
        """Delete stashed tables that no later plan reads."""
        for df in tables:
            delete(self.spark, df._stash_path)

    def drop(self) -> None:
        delete(self.spark, self.root)
        if self in Stash.live:
            Stash.live.remove(self)


@contextmanager
def _batches_of(spark: SparkSession, rows: int | None):
    """Plans that run inside send at most ``rows`` rows to a worker at once; the session's setting holds where it is smaller."""
    before = spark.conf.get(_BATCH)
    if rows is None or 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(_BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


_clear: list = []


def sole(clear) -> None:
    """For a task that fills its worker's cache, which ``clear`` empties: what other operators' tasks left in this worker goes first.

    Spark keeps a worker for the next operator's tasks, so without this the caches of all operators of a pipeline add up.
    """
    if _clear and _clear[0] != clear:
        _clear.pop()()
        pa.default_memory_pool().release_unused()
        with suppress(AttributeError, OSError):  # glibc only: freed memory goes back to the system
            ctypes.CDLL(None).malloc_trim(0)
    if not _clear:
        _clear.append(clear)


def lean(batches):
    """The batches; after each, what Arrow has freed goes back to the system. Its pool would keep the most that it ever held."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


@contextmanager
def scratch():
    """Removes the stashes that operators make inside: write what they return before the block ends."""
    before = list(Stash.live)
    try:
        yield
    finally:
        for stash in [s for s in Stash.live if s not in before]:
            stash.drop()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` begins with it (case ignored), so that longer names are free too."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as SQL, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def own(df: DataFrame) -> list[Column]:
    """The columns of ``df``, also those whose names hold dots."""
    return [F.col(quoted(c)) for c in df.columns]


def whole_text(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(quoted(column)).cast("string"), F.lit(""))
