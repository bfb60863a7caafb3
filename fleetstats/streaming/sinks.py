"""Starting streams and sending one stream to several targets."""

from __future__ import annotations

import logging
import traceback
from collections.abc import Callable, Collection, Mapping
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger(__name__)

SNAPSHOT_INTERVAL_MS = 1500
CONTAINER_INTERVAL_MS = 5000
FAILURES = "batch_id bigint, target string, error string"

Target = str | Callable[[DataFrame, int], None]


def query_id(spark: SparkSession) -> str:
    """Of the stream whose batch is being written; it stays with the stream's checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


class TableSink:
    """A sink that keeps each batch in its own folder, by query and batch id.

    A repeated batch replaces itself instead of adding its rows twice, and a batch of another
    query never replaces it: a query's id stays with its checkpoint.
    """

    def __init__(self, path: str, format: str = "parquet") -> None:
        self.path, self.format = path, format

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.format(self.format).mode("overwrite").save(f"{self.path}/query={query_id(batch.sparkSession)}/batch_id={batch_id}")


def table_sink(path: str, format: str = "parquet") -> TableSink:
    return TableSink(path, format)


def read_table(spark: SparkSession, path: str, schema, format: str = "parquet") -> DataFrame:
    """All batches of a ``table_sink`` folder, with their ``batch_id``."""
    found = spark.read.format(format).schema(schema).option("basePath", path).load(f"{path}/query=*/batch_id=*")
    return found.drop("query")


def start(
    df: DataFrame,
    sink: Callable[[DataFrame, int], None],
    interval_ms: int = SNAPSHOT_INTERVAL_MS,
    checkpoint: str | None = None,
    mode: str = "append",
    available_now: bool = False,
) -> StreamingQuery:
    """Run a stream into a per-batch sink every ``interval_ms``, or once over what is there.

    A stream goes on from its ``checkpoint``.  A sink with a ``path`` keeps it there by default; any
    other sink has to be given one, because a stream without it would begin anew at every start.
    """
    if checkpoint is None:
        if getattr(sink, "path", None) is None:
            raise ValueError("a stream into a function needs a checkpoint folder")
        checkpoint = f"{sink.path}/_checkpoint"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{interval_ms} milliseconds").start()


class FanOut:
    """Per-batch sink that writes every batch to each target.

    A failing target costs the others nothing: they are served first.  Then the batch fails, so that Spark
    repeats it and no target misses it.  Targets named in ``optional`` may fail without that: what they
    missed is recorded in the ``failures`` folder with target, batch id and error, and they are tried
    again with the next batch.
    """

    def __init__(self, targets: Mapping[str, Target], failures: str | None = None, optional: Collection[str] = ()) -> None:
        if optional and failures is None:
            raise ValueError("optional targets need a folder for their failures")
        self.targets = {name: table_sink(t) if isinstance(t, str) else t for name, t in targets.items()}
        self.failures, self.optional = failures, frozenset(optional)
        self.path = next((t.path for t in self.targets.values() if isinstance(t, TableSink)), None)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if len(self.targets) > 1:
            batch.persist()
        try:
            with ThreadPool(len(self.targets)) as pool:
                outcomes = pool.map(inheritable_thread_target(lambda name: self._serve(name, batch, batch_id)), self.targets)
        finally:
            if len(self.targets) > 1:
                batch.unpersist()
        broken = {name: error for name, error in zip(self.targets, outcomes) if error}
        if broken and self.failures:
            rows = [(batch_id, name, error) for name, error in broken.items()]
            batch.sparkSession.createDataFrame(rows, FAILURES).write.mode("append").parquet(self.failures)
        if broken.keys() - self.optional:
            raise RuntimeError(f"targets failed in batch {batch_id}: {sorted(broken.keys() - self.optional)}")

    def _serve(self, name: str, batch: DataFrame, batch_id: int) -> str | None:
        try:
            self.targets[name](batch, batch_id)
        except Exception:
            log.exception("target %s failed in batch %s", name, batch_id)
            return traceback.format_exc()
        return None


def write_stream(
    df: DataFrame,
    targets: Mapping[str, Target],
    failures: str | None = None,
    optional: Collection[str] = (),
    outbox: str | None = None,
    **options,
) -> StreamingQuery:
    """Send a stream to several targets, each a folder or a function of (batch, batch id).

    With an ``outbox`` folder, batches are kept until every target has them (``delivery.Outbox``), which
    records failures there; without it what an optional target missed is only recorded.
    """
    if outbox is not None:
        from fleetstats.streaming.delivery import Outbox

        return start(df, Outbox(outbox, targets, optional), **options)
    return start(df, FanOut(targets, failures, optional), **options)
