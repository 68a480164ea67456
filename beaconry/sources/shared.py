"""The folder that driver and executors share, and folders in it that live as long as the driver."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names.

    Where it is unset a local master gets a temporary folder; on a cluster executors couldn't reach one, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "local" not in _own:
        _own["local"] = f"file://{tempfile.mkdtemp(prefix='beaconry-')}"
        atexit.register(delete, spark, _own["local"])
    return _own["local"]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if the session still lives."""
    context = spark.sparkContext
    try:
        if context._jsc is not None:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may end at the same time
        pass


def new_folder(spark: SparkSession) -> str:
    """A fresh folder name below the shared one; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/beaconry-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path
