"""Snapshot and container readers, batch or streaming, always with a given schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.functions.times import ms_to_ts
from fleetstats.schemas import (
    CONTAINER_LIST,
    CONTAINER_STATS,
    DOCUMENTS,
    SNAPSHOT,
    SNAPSHOT_WIRE,
)

WIRE_FORMATS = ("json",)


def narrow(df: DataFrame) -> DataFrame:
    """Wire documents to landed snapshots: host and event time out, counters down to ``bigint``."""
    return df.select(
        F.col("system.hostname").alias("host"),
        ms_to_ts("timestamp").alias("ts"),
        *[
            F.expr(f"try_cast(`{name}` AS {kind})").alias(name)
            for name, kind in DOCUMENTS.items()
        ],
    )


def _reader(spark: SparkSession, streaming: bool, options: dict | None):
    return (spark.readStream if streaming else spark.read).options(**(options or {}))


def read_snapshots(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    streaming: bool = False,
    options: dict | None = None,
) -> DataFrame:
    """Landed snapshots: a ``parquet`` (or other table format) folder of ``schemas.SNAPSHOT`` rows,
    or ``json`` lines of wire documents.
    """
    reader = _reader(spark, streaming, options).format(format)
    if format in WIRE_FORMATS:
        return narrow(reader.schema(SNAPSHOT_WIRE).load(path))
    return reader.schema(SNAPSHOT).load(path)


def read_containers(
    spark: SparkSession,
    list_path: str,
    stats_path: str,
    format: str = "json",
    streaming: bool = False,
    options: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Container lists and stats documents; ``operators.containers.containers`` joins them.

    A stats document that does not parse gives a row of NULLs, which no container matches, so its
    container keeps zero metrics.
    """
    listed = _reader(spark, streaming, options).format(format).schema(CONTAINER_LIST)
    stats = _reader(spark, streaming, options).format(format).schema(CONTAINER_STATS)
    return listed.load(list_path), stats.load(stats_path)
