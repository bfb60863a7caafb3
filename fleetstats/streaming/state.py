"""Keyed state of streams: state per key, with timers on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fleetstats.plans.slices import micros

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """Let streams of this session started from now on keep their state in RocksDB, which timers need.

    State then lies on the executors' disks and only what changed goes into a checkpoint.
    """
    spark.conf.set(PROVIDER, ROCKSDB)


def clocked(df: DataFrame, ts: str, late: str, at: str) -> DataFrame:
    """``df`` with its event time in microseconds as ``at``, and a watermark that drives timers but drops no row.

    The watermarked column itself goes no further, so rows behind the watermark reach the state all the same and
    its operator decides what becomes of them.
    """
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    marked = timed.withColumn("_clock", F.timestamp_micros(micros(ts))).withWatermark("_clock", late)
    return marked.withColumn(at, F.unix_micros("_clock")).drop("_clock")


def as_state(value):
    """A value as state takes it: rows within rows as mappings."""
    return value.asDict(recursive=True) if isinstance(value, Row) else value


def fields(value) -> list:
    """The values of a row that came out of state, which may give it as a mapping."""
    return list(value.values()) if isinstance(value, dict) else list(value)
