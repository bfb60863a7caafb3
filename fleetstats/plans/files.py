"""Small files in any file system that Spark knows, for what has to be noted beside tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, in order; nothing where there is no such folder.  Hidden files are passed over."""
    files, at = _at(spark, folder)
    found = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(n for n in found if not n.startswith((".", "_")))


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)


def read(spark: SparkSession, path: str) -> str:
    files, at = _at(spark, path)
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write(spark: SparkSession, path: str, text: str = "") -> bool:
    """Make a file whole or not at all; False if it is there already.

    It is written under another name first.  Of two writers of one name a file system that renames atomically lets one
    through; where renaming is copying, let one writer at a time write a table.
    """
    files, at = _at(spark, path)
    if files.exists(at):
        return False
    _, draft = _at(spark, f"{path.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}")
    stream = files.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if files.rename(draft, at):
        return True
    files.delete(draft, False)
    return False
