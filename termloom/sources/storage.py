"""Small-file access through Hadoop's FileSystem, on any path Spark can use."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop_path.getFileSystem(conf), hadoop_path, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, target, _ = _fs(spark, path)
    return fs.exists(target)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; none when it does not exist."""
    fs, target, _ = _fs(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def read_text(spark: SparkSession, path: str) -> str:
    fs, target, jvm = _fs(spark, path)
    stream = fs.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write beside ``path``, then rename; False when ``path`` exists already."""
    fs, target, jvm = _fs(spark, path)
    if fs.exists(target):
        return False
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(draft)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    return fs.rename(draft, target)


def publish_folder(spark: SparkSession, draft: str, path: str) -> bool:
    """Rename the folder ``draft`` to ``path``; False when ``path`` exists already."""
    fs, target, jvm = _fs(spark, path)
    if fs.exists(target):
        return False
    fs.mkdirs(target.getParent())
    return fs.rename(jvm.org.apache.hadoop.fs.Path(draft), target)


def delete(spark: SparkSession, path: str) -> None:
    fs, target, _ = _fs(spark, path)
    fs.delete(target, True)
