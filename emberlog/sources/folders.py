"""Directory listing and removal through Hadoop's FileSystem, for any storage Spark reads.

Only partition directory names pass through the driver, never rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path(spark, path)
    return fs.exists(hadoop_path)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob, sorted; none when the parent is missing."""
    hadoop_path, fs = _path(spark, pattern)
    found = fs.globStatus(hadoop_path)
    return sorted(status.getPath().toString() for status in found or [])


def remove(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path(spark, path)
    return fs.delete(hadoop_path, True)


def size(spark: SparkSession, path: str, suffix: str) -> int:
    """Bytes of all files below ``path`` with this ending, from the listing."""
    hadoop_path, fs = _path(spark, path)
    files, total = fs.listFiles(hadoop_path, True), 0
    while files.hasNext():
        status = files.next()
        if status.getPath().getName().endswith(suffix):
            total += status.getLen()
    return total


def make(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _path(spark, path)
    fs.mkdirs(hadoop_path)


def read_text(spark: SparkSession, path: str) -> str:
    """Content of one small file."""
    hadoop_path, fs = _path(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file in one step; False when it is there already."""
    target, fs = _path(spark, path)
    if fs.exists(target):
        return False
    draft, _ = _path(spark, f"{path.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}")
    stream = fs.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    done = fs.rename(draft, target)
    if not done:
        fs.delete(draft, False)
    return done


def partition_values(path: str) -> dict[str, str]:
    """``…/dt=2024-01-01/batch_id=x`` to ``{"dt": "2024-01-01", "batch_id": "x"}``."""
    parts = (part.split("=", 1) for part in path.split("/") if "=" in part)
    return dict(parts)
