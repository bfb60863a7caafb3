"""Side tables written once to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetstats.session import shared_folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def session_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that is removed when the driver's JVM ends.

    Results are lazy, so what they read has to stay as long as the session that reads them.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fresh_folder(spark, name))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return str(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an aggregated side table to the shared folder and read it back.

    The written files give the optimizer the table's true size, so it broadcasts the table only
    below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it beyond.  The table also survives
    the loss of executors and is computed once for all of its readers.  It belongs to the session
    and goes with it, or with ``unstage``.
    """
    path = f"{session_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables, as ``stage`` returned them, that only other staged tables were made of."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
