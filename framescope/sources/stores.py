"""Files of any store that pyarrow knows, for what Spark's own readers can't do: ranges of a file, and writing bytes as they are."""

from __future__ import annotations

import tempfile

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession


def store_of(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), path
    return arrow_fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names in spark.checkpoint.dir; only a session on local threads gets one of its own."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="framescope-"))
    return sc.getCheckpointDir().rstrip("/")
