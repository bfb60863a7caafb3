"""Delivery of a stream to several targets, each of which gets every batch once, however long it was away."""

from __future__ import annotations

import logging
import traceback
from collections.abc import Collection, Mapping
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from fleetstats.plans import files
from fleetstats.streaming.sinks import FAILURES, Target, query_id, table_sink

log = logging.getLogger(__name__)


class Outbox:
    """Per-batch sink that keeps batches until every target has them.

    A batch is written to the outbox once; each target has an offset, the last batch that it took.  A target is sent, in
    order, all batches behind its offset, so one that failed is sent what it missed with the next batch, or by ``redeliver``.
    Its failures cost the others nothing: a batch that Spark repeats is sent only to those that lack it.  Unless a
    target is ``optional``, the batch fails while the target is behind.

    An offset is noted after the target returns.  Should the driver be lost in between, the target is sent that batch again with the
    same id; folders of tables replace the batch, and a function has to.  Batches that all targets have are deleted,
    so the outbox is as long as the slowest target is behind.
    """

    def __init__(self, path: str, targets: Mapping[str, Target], optional: Collection[str] = ()) -> None:
        self.path, self.optional = path, frozenset(optional)
        self.targets = {name: table_sink(t) if isinstance(t, str) else t for name, t in targets.items()}

    def _folder(self, query: str) -> str:
        return f"{self.path}/query={query}"

    def offset(self, spark: SparkSession, query: str, target: str) -> int:
        """The last batch that a target took; -1 before the first."""
        taken = files.names(spark, f"{self._folder(query)}/offsets/{target}")
        return int(taken[-1]) if taken else -1

    def _note(self, spark: SparkSession, query: str, target: str, batch_id: int) -> None:
        folder = f"{self._folder(query)}/offsets/{target}"
        files.write(spark, f"{folder}/{batch_id:020}")
        for old in files.names(spark, folder)[:-1]:
            files.delete(spark, f"{folder}/{old}")

    def _held(self, spark: SparkSession, query: str) -> list[int]:
        return [int(n) for n in files.names(spark, f"{self._folder(query)}/held")]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, query = batch.sparkSession, query_id(batch.sparkSession)
        if batch_id not in self._held(spark, query) and any(self.offset(spark, query, t) < batch_id for t in self.targets):
            batch.write.mode("overwrite").parquet(f"{self._folder(query)}/batches/{batch_id:020}")
            files.write(spark, f"{self._folder(query)}/held/{batch_id:020}")
        behind = self.redeliver(spark, batch.schema, query)
        if behind.keys() - self.optional:
            raise RuntimeError(f"targets failed in batch {batch_id}: {sorted(behind.keys() - self.optional)}")

    def redeliver(self, spark: SparkSession, schema, query: str | None = None) -> dict[str, str]:
        """Send every target what it lacks; those that failed, with their errors, which are recorded too."""
        if query is None:
            errors: dict[str, str] = {}
            for name in files.names(spark, self.path):
                if name.startswith("query="):
                    errors |= self.redeliver(spark, schema, name.removeprefix("query="))
            return errors
        held = self._held(spark, query)

        def serve(name: str) -> tuple[int, str] | None:
            for batch_id in [b for b in held if b > self.offset(spark, query, name)]:
                try:
                    self.targets[name](spark.read.schema(schema).parquet(f"{self._folder(query)}/batches/{batch_id:020}"), batch_id)
                    self._note(spark, query, name, batch_id)
                except Exception:
                    log.exception("target %s failed in batch %s", name, batch_id)
                    return batch_id, traceback.format_exc()
            return None

        with ThreadPool(len(self.targets)) as pool:
            outcomes = dict(zip(self.targets, pool.map(inheritable_thread_target(serve), self.targets)))
        broken = {name: error for name, error in outcomes.items() if error}
        if broken:
            rows = [(batch_id, name, error) for name, (batch_id, error) in broken.items()]
            spark.createDataFrame(rows, FAILURES).coalesce(1).write.mode("append").parquet(f"{self.path}/failures")
        done = min(self.offset(spark, query, t) for t in self.targets)
        for batch_id in [b for b in held if b <= done]:
            files.delete(spark, f"{self._folder(query)}/held/{batch_id:020}")
            files.delete(spark, f"{self._folder(query)}/batches/{batch_id:020}")
        return {name: error for name, (_, error) in broken.items()}
