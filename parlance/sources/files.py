"""Folders that are published whole, through the file system that Spark uses."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MANIFEST = "_MANIFEST"


def _at(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def found(spark: SparkSession, path: str) -> bool:
    """Whether there are files for path, which may be a pattern."""
    fs, at = _at(spark, path)
    return bool(fs.globStatus(at))


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote the folder came to its end."""
    fs, at = _at(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def listed(spark: SparkSession, path: str) -> dict[str, int]:
    """Names and lengths of a folder's data files."""
    fs, at = _at(spark, path)
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(at) if not s.getPath().getName().startswith(("_", "."))}


def _rename(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"{a} could not be renamed to {b}")


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Lets write(folder) fill a folder beside path, lists its files in a manifest, and puts it in path's place.

    If write fails, what was at path stays as it was. What was there is moved aside by one rename and comes back if
    the next one fails; a driver that dies between the two leaves it for `restore`.
    """
    restore(spark, path)
    fs, at = _at(spark, path)
    staged = f"{at.getParent()}/.{at.getName()}.staged-{uuid.uuid4().hex}"
    _, stage = _at(spark, staged)
    try:
        write(staged)
        if not complete(spark, staged):
            raise OSError(f"{staged} was not written to its end")
        _, manifest = _at(spark, f"{staged}/{MANIFEST}")
        out = fs.create(manifest, True)
        out.write(bytearray(json.dumps(listed(spark, staged)).encode()))
        out.close()
        _, aside = _at(spark, f"{at.getParent()}/.{at.getName()}.old")
        there = fs.exists(at)
        if there:
            _rename(fs, at, aside)
        try:
            _rename(fs, stage, at)
        except Exception:
            if there:
                _rename(fs, aside, at)
            raise
        if there:
            fs.delete(aside, True)
    finally:
        fs.delete(stage, True)


def restore(spark: SparkSession, path: str) -> None:
    """Brings back what a publisher that died had moved aside, or removes it if the new folder is in place."""
    fs, at = _at(spark, path)
    _, aside = _at(spark, f"{at.getParent()}/.{at.getName()}.old")
    if fs.exists(aside):
        if fs.exists(at):
            fs.delete(aside, True)
        else:
            _rename(fs, aside, at)


def intact(spark: SparkSession, path: str) -> bool:
    """Whether a published folder holds the files that its manifest lists."""
    fs, at = _at(spark, f"{path}/{MANIFEST}")
    if not fs.exists(at):
        return False
    stream = fs.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) == listed(spark, path)
