"""Folders on whatever file system Spark reads and writes, through Hadoop's own interface."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches `path`, which may be a pattern."""
    files, place = _place(spark, path)
    return bool(files.globStatus(place))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder with all that is in it; one that doesn't exist is left alone."""
    files, place = _place(spark, path)
    files.delete(place, True)


def scratch(spark: SparkSession) -> str:
    """A new folder that executors share, deleted when the session's JVM ends.

    It is below spark.checkpoint.dir. Only in local mode, where that may be unset, it is in the
    machine's temporary folder; on a cluster that would not be shared, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    files, place = _place(spark, f"{root}/quernstone-{uuid.uuid4().hex}")
    files.mkdirs(place)
    files.deleteOnExit(place)
    return files.makeQualified(place).toString()
