"""Small metadata files and listings through Hadoop's file system API."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _open(spark, path)
    return fs.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Entry names of a folder, sorted; empty when there is no folder."""
    fs, target = _open(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def claim(spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """Make sure ``path`` is free: refuse a folder with entries, or empty it on request."""
    fs, target = _open(spark, path)
    if not names(spark, path):
        return
    if not overwrite:
        raise FileExistsError(f"{path} is not empty; pass overwrite=True to replace it")
    fs.delete(target, True)


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    """Write beside the target, then rename, so readers never see half a file."""
    fs, target = _open(spark, path)
    partial = target.suffix(".tmp")
    stream = fs.create(partial, True)
    stream.write(bytearray(json.dumps(payload, indent=2, sort_keys=True).encode("utf-8")))
    stream.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(partial, target)


def read_json(spark: SparkSession, path: str) -> dict:
    fs, target = _open(spark, path)
    stream = fs.open(target)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)
