"""Where tables of this library are kept: the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where none is set and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="mdspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name for tables that go when the application ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    path, files = path_of(spark, folder)
    files.deleteOnExit(path)
    return folder


def path_of(spark: SparkSession, name: str):
    """The Hadoop path, and the file system it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, files = path_of(spark, name)
    return files.exists(path)


def delete(spark: SparkSession, name: str) -> None:
    path, files = path_of(spark, name)
    files.delete(path, True)


def default_index(spark: SparkSession, source: str) -> str:
    """A folder for the index of ``source``, by 16 hex digits of its whole path."""
    path, files = path_of(spark, source)
    whole = files.makeQualified(path).toString()
    return f"{shared_folder(spark)}/index-{hashlib.sha256(whole.encode()).hexdigest()[:16]}"


def fingerprint(spark: SparkSession, frame: DataFrame) -> str:
    """Changes when one of the files that ``frame`` reads does."""
    seen = hashlib.sha256()
    for name in sorted(frame.inputFiles()):
        path, files = path_of(spark, name)
        state = files.getFileStatus(path)
        seen.update(f"{name}|{state.getLen()}|{state.getModificationTime()}\n".encode())
    return seen.hexdigest()[:16]
