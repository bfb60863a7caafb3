"""Idle-gap sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetstats.plans.slices import micros, slice_start, to_micros

IDLE_GAP = "30 minutes"


def idle_sessions(
    df: DataFrame, gap: str = IDLE_GAP, keys: Sequence[str] = ("host",), ts: str = "ts"
) -> DataFrame:
    """Sessions that end ``gap`` after their last message; a pause of exactly ``gap`` goes on.

    Messages within one interval of length ``gap`` are always of one session.  They are therefore
    first combined per (host, interval) before any shuffle of single messages, and the pass over a
    host sees one row per interval, however busy the host is.
    """
    idle = F.make_dt_interval(secs=F.lit(to_micros(gap)).cast("decimal(18,6)") / 10**6)
    busy = (
        df.where(F.col(ts).isNotNull())
        .groupBy(*keys, slice_start(ts, gap).alias("_interval"))
        .agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.count("*").alias("_count"))
    )
    by_time = Window.partitionBy(*keys).orderBy("_from")
    pause = micros("_from") - micros(F.lag("_to").over(by_time))
    return (
        busy.withColumn("_opens", F.coalesce(pause > to_micros(gap), F.lit(True)).cast("int"))
        .withColumn("_session", F.sum("_opens").over(by_time))
        .groupBy(*keys, "_session")
        .agg(
            F.min("_from").alias("session_start"),
            F.max("_to").alias("last_message"),
            F.sum("_count").alias("messages"),
        )
        .withColumn("session_end", F.col("last_message") + idle)
        .drop("_session")
    )
