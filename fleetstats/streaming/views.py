"""Running views of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstats.operators.series import sample
from fleetstats.operators.sessions import IDLE_GAP


def watermarked(df: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Event time as a zoned timestamp (watermarks take no other) with a lateness bound."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def stream_latest(
    df: DataFrame,
    keys: Sequence[str] = ("host",),
    ts: str = "ts",
    seq: Sequence[str] = (),
) -> DataFrame:
    """The newest row per host so far; run in ``update`` or ``complete`` mode.

    State is one row per host, and each task sends one candidate per host to the shuffle.
    """
    order = F.struct(ts, *seq) if seq else F.col(ts)
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("_newest"))
        .select(*keys, "_newest.*")
    )


def stream_sessions(
    df: DataFrame,
    gap: str = IDLE_GAP,
    keys: Sequence[str] = ("host",),
    ts: str = "ts",
    late: str = "10 minutes",
) -> DataFrame:
    """Idle-gap sessions of a stream.

    ``append`` mode emits a session once the watermark passes its end; ``complete`` mode shows open
    ones as well.  With the setting that ``build_session`` makes, sessions are merged before the
    shuffle, so that a busy host sends its sessions and not its messages.
    """
    return (
        watermarked(df, ts, late)
        .groupBy(*keys, F.session_window(ts, gap).alias("_session"))
        .agg(F.max(ts).alias("last_message"), F.count("*").alias("messages"))
        .select(
            *keys,
            F.col("_session.start").alias("session_start"),
            "last_message",
            "messages",
            F.col("_session.end").alias("session_end"),
        )
    )


def stream_sample(
    df: DataFrame,
    every: str = "1500 milliseconds",
    values: Sequence[str] = ("cpu_avg", "mem_percent"),
    keys: Sequence[str] = ("host",),
    ts: str = "ts",
    seq: Sequence[str] = (),
    late: str = "10 minutes",
) -> DataFrame:
    """``operators.series.sample`` on a stream.

    ``append`` mode emits a tick once it is closed; ``update`` mode emits open ticks as well, those that a batch has changed, of which
    ``newest_updates`` makes the current view.
    """
    return sample(watermarked(df, ts, late), every, values, keys, ts, seq)


def newest_updates(landed: DataFrame, keys: Sequence[str] = ("host", "tick"), batch: str = "batch_id") -> DataFrame:
    """Of what ``update`` mode landed, the row of the newest batch per key.

    Each batch lands only what it changed, so a view of open ticks costs the stream what has moved and not, as ``complete`` mode does,
    the whole table in every batch.
    """
    rest = [c for c in landed.columns if c not in (*keys, batch)]
    newest = F.max_by(F.struct(*rest), F.col(batch)).alias("_newest")
    return landed.groupBy(*keys).agg(newest).select(*keys, "_newest.*")
