"""Tables that streams land in: a manifest of what is live, date folders, counts beside the rows, compaction."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.plans import files
from fleetstats.plans.slices import SLICE, slice_start
from fleetstats.streaming.sinks import query_id

DATE = "date"


@dataclass
class Manifest:
    """Which folders of a table are live, and which were until the compaction before last."""

    version: int = -1
    live: list[str] = field(default_factory=list)
    old: list[str] = field(default_factory=list)
    older: list[str] = field(default_factory=list)


class LandedTable:
    """A sink that lands each batch in a folder of its own, by date, and a reader of what is live.

    A manifest lists the live folders; readers take its newest version and nothing else, so they see a batch whole or not at all, and
    a repeated batch replaces itself.  When ``compact_every`` folders of one level are live, they become one folder of the next
    level, with files by date of the size that the adaptive planner aims at; the manifest then changes at once from the many to
    the one.  Folders it no longer lists stay for one further compaction, so that running readers end well.

    Beside the rows each folder has their counts per key and time slice.  Counts add up, so ``operators.series.tail`` needs
    no pass over the history to know which slices hold a key's last rows.

    One stream writes a table; compaction by others meanwhile is safe where renaming is atomic (``plans.files.write``).
    """

    def __init__(self, path: str, keys: Sequence[str] = ("host",), ts: str = "ts", compact_every: int = 64, width: str = SLICE) -> None:
        self.path, self.keys, self.ts, self.compact_every, self.width = path, list(keys), ts, compact_every, width

    def manifest(self, spark: SparkSession) -> Manifest:
        versions = files.names(spark, f"{self.path}/manifest")
        return Manifest(**json.loads(files.read(spark, f"{self.path}/manifest/{versions[-1]}"))) if versions else Manifest()

    def _publish(self, spark: SparkSession, change) -> Manifest:
        """Make the next version of the manifest; if another writer was faster, from what that one made."""
        while True:
            now = self.manifest(spark)
            then = change(now)
            if then is None:
                return now
            then.version = now.version + 1
            if files.write(spark, f"{self.path}/manifest/{then.version:020}", json.dumps(vars(then))):
                for gone in files.names(spark, f"{self.path}/manifest")[:-3]:
                    files.delete(spark, f"{self.path}/manifest/{gone}")
                return then

    def _counts(self, rows: DataFrame) -> DataFrame:
        sliced = rows.withColumn("_slice", slice_start(self.ts, self.width))
        return sliced.groupBy(*self.keys, "_slice").agg(F.count("*").alias("_rows"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = f"l0-{query_id(spark)}-{batch_id}"
        dated = batch.withColumn(DATE, F.to_date(F.col(self.ts)))
        dated.write.mode("overwrite").partitionBy(DATE).parquet(f"{self.path}/rows/in={name}")
        landed = spark.read.schema(dated.schema).option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows/in={name}")
        self._counts(landed).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts/in={name}")

        def listed(now: Manifest) -> Manifest | None:
            # A batch that a compaction has taken up is not taken up again.
            if name in now.live or name in now.old or name in now.older or batch_id <= self._compacted(now, name):
                return None
            return Manifest(live=[*now.live, name], old=now.old, older=now.older)

        self._publish(spark, listed)
        self.compact(spark)

    @staticmethod
    def _compacted(now: Manifest, name: str) -> int:
        """The last batch of a query that compactions have taken up; their names tell."""
        query = name.split("-", 1)[1].rsplit("-", 1)[0]
        ends = [int(n.rsplit("-", 2)[1]) for n in now.live if not n.startswith("l0-") and n.split("-", 1)[1].rsplit("-", 2)[0] == query]
        return max(ends, default=-1)

    def _read(self, spark: SparkSession, kind: str, live: Sequence[str], schema: str) -> DataFrame:
        if not live:
            return spark.createDataFrame([], schema)
        paths = [f"{self.path}/{kind}/in={n}" for n in live]
        return spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths).drop("in")

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """All rows that have landed, with their ``date``; conditions on it leave folders out."""
        return self._read(spark, "rows", self.manifest(spark).live, f"{schema}, {DATE} date")

    def counts(self, spark: SparkSession, schema: str) -> DataFrame:
        """Rows per key and ``_slice``; ``schema`` is that of the rows."""
        kinds = spark.createDataFrame([], schema).select(*self.keys).schema
        plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
        parts = self._read(spark, "counts", self.manifest(spark).live, f"{plain}, _slice bigint, _rows bigint")
        return parts.groupBy(*self.keys, "_slice").agg(F.sum("_rows").alias("_rows"))

    def compact(self, spark: SparkSession) -> bool:
        """Join the folders of each level that has enough of them; whether there were any."""
        did, level = False, 0
        while True:
            at_level = [n for n in self.manifest(spark).live if n.startswith(f"l{level}-")]
            if not at_level:
                return did
            by_query: dict[str, list[str]] = {}
            for n in at_level:
                by_query.setdefault(n.split("-", 1)[1].rsplit("-", 1 if level == 0 else 2)[0], []).append(n)
            for query, some in by_query.items():
                if len(some) >= self.compact_every:
                    self._join(spark, some, level, query)
                    did = True
            level += 1

    def _join(self, spark: SparkSession, some: list[str], level: int, query: str) -> None:
        last = max(int(n.rsplit("-", 1 if level == 0 else 2)[1]) for n in some)
        name = f"l{level + 1}-{query}-{last}-{uuid.uuid4().hex[:8]}"
        paths = [f"{self.path}/rows/in={n}" for n in some]
        rows = spark.read.option("basePath", f"{self.path}/rows").parquet(*paths).drop("in")
        rows.hint("rebalance", DATE).write.partitionBy(DATE).parquet(f"{self.path}/rows/in={name}")
        counts = spark.read.option("basePath", f"{self.path}/counts").parquet(*[f"{self.path}/counts/in={n}" for n in some])
        added = counts.groupBy(*self.keys, "_slice").agg(F.sum("_rows").alias("_rows"))
        added.coalesce(1).write.parquet(f"{self.path}/counts/in={name}")

        def swapped(now: Manifest) -> Manifest | None:
            if not set(some) <= set(now.live):
                return None  # another writer joined them
            return Manifest(live=[n for n in now.live if n not in some] + [name], old=some, older=now.old)

        before = self.manifest(spark)
        after = self._publish(spark, swapped)
        if name in after.live:
            for gone in before.older:
                for kind in ("rows", "counts"):
                    files.delete(spark, f"{self.path}/{kind}/in={gone}")
