"""Message streams to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetstats.operators.series import HISTORY_POINTS, history_points, tail
from fleetstats.schemas import HISTORY
from fleetstats.sources import messages
from fleetstats.streaming.sinks import FanOut, start, table_sink
from fleetstats.streaming.tables import DATE, LandedTable


def ingest(
    lines: DataFrame, folder: str, value: str = "value", host: str = "host", ts: str = "ts", **options
) -> StreamingQuery:
    """Decode a stream of messages and land each kind in its own table under ``folder``.

    Unknown and unparsable messages land in ``rejected`` with their text and the reason, and the stream
    goes on.  The tables of a batch are written side by side; if one fails the batch is repeated.
    """
    sinks = {
        "snapshots": (messages.snapshots, table_sink(f"{folder}/snapshots")),
        "history": (lambda d: messages.history(d, host=host), table_sink(f"{folder}/history")),
        "containers": (
            lambda d: messages.containers(d, host=host, ts=ts),
            table_sink(f"{folder}/containers"),
        ),
        "rejected": (
            lambda d: d.where(F.col("route").isin(messages.UNKNOWN, messages.CORRUPT)).select(
                host, ts, value, "route"
            ),
            table_sink(f"{folder}/rejected"),
        ),
    }

    def land(batch: DataFrame, batch_id: int) -> None:
        decoded = messages.decode(batch, value).persist()
        try:
            FanOut({name: lambda b, i, shape=shape, sink=sink: sink(shape(b), i) for name, (shape, sink) in sinks.items()})(decoded, batch_id)
        finally:
            decoded.unpersist()

    return start(lines, land, checkpoint=options.pop("checkpoint", None) or f"{folder}/_checkpoint", **options)


def record_history(snapshots: DataFrame, folder: str, compact_every: int = 64, **options) -> StreamingQuery:
    """Append a history point per streamed snapshot to a ``LandedTable``; ``retained_history`` reads its tail."""
    return start(history_points(snapshots), LandedTable(folder, compact_every=compact_every), **options)


def retained_history(spark: SparkSession, folder: str, n: int = HISTORY_POINTS, schema: str = HISTORY, **options) -> DataFrame:
    """The last ``n`` recorded points per host.

    Which slices hold them follows from the counts that are kept beside the points; only days from the oldest of these on are read.
    """
    recorded = LandedTable(folder)
    return tail(recorded.read(spark, schema), n, counts=recorded.counts(spark, schema), date=DATE, **options).drop(DATE)
