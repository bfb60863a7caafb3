"""What a newly attached reader is sent: the newest snapshot, then the retained history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstats.operators.assemble import ordered_list
from fleetstats.operators.series import HISTORY_POINTS, latest, tail
from fleetstats.sources.messages import (
    HISTORY_TYPE,
    SNAPSHOT_TYPE,
    history_point,
    message,
    snapshot_payload,
)


def replay_rows(
    snapshots: DataFrame,
    history: DataFrame,
    n: int = HISTORY_POINTS,
    keys: Sequence[str] = ("host",),
    ts: str = "ts",
    seq: Sequence[str] = (),
) -> DataFrame:
    """The rows of a replay: ``part`` is ``snapshot`` or ``history``, ``place`` its order."""
    newest = latest(snapshots, keys, ts, seq).withColumns(
        {"part": F.lit(SNAPSHOT_TYPE), "place": F.lit(0)}
    )
    kept = tail(history, n, keys, ts, seq).withColumns(
        {"part": F.lit(HISTORY_TYPE), "place": F.lit(1)}
    )
    return newest.unionByName(kept, allowMissingColumns=True)


def replay(
    snapshots: DataFrame,
    history: DataFrame,
    host: str | None = None,
    n: int = HISTORY_POINTS,
    payload: Column | None = None,
    point: Column | None = None,
) -> DataFrame:
    """Messages per host in sending order: ``host, place, value``.

    A host without history is sent no history message.  The history message holds at most ``n``
    points, which bounds the list it collects.
    """
    if host is not None:
        snapshots = snapshots.where(F.col("host") == host)
        history = history.where(F.col("host") == host)
    first = latest(snapshots).select(
        "host",
        F.lit(0).alias("place"),
        message(SNAPSHOT_TYPE, snapshot_payload() if payload is None else payload).alias("value"),
    )
    points = (
        tail(history, n)
        .groupBy("host")
        .agg(ordered_list(["ts"], history_point() if point is None else point).alias("points"))
    )
    then = points.select(
        "host", F.lit(1).alias("place"), message(HISTORY_TYPE, F.col("points")).alias("value")
    )
    return first.unionByName(then)
