"""Streams of several inputs over the tables at hand, each to agree with its batch counterpart.

Inputs are written as files that a stream takes one by one.  A closing row, later than all others, lets the watermark pass
what is there; its host is ``CLOSING`` and it is left out of what is compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstats.operators.containers import containers
from fleetstats.operators.series import tail
from fleetstats.plans.catalog import query, table
from fleetstats.plans.catalog_joins import CONTAINERS_SQL, container_tables
from fleetstats.plans.catalog_series import AS_OF_SQL, BACKFILL_DEDUPE_SQL, as_of_sides, backfill_and_live
from fleetstats.plans.catalog_streams import landed
from fleetstats.plans.files import names
from fleetstats.plans.staging import session_folder
from fleetstats.sources.snapshots import read_containers
from fleetstats.streaming.joins import stream_as_of, stream_assemble, stream_backfill, stream_containers

CLOSING = -1
LATER = "TIMESTAMP'2100-01-01'"
# Rows that one task writes to a file.
FILE_ROWS = 500_000


def in_files(df: DataFrame, *conditions: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """A stream of the rows, those under each condition after the other.

    A micro-batch takes as many files as the largest condition needs at ``file_rows`` rows a file; where rows fill fewer,
    empty files make up the number, so that a condition is a micro-batch.
    """
    spark = df.sparkSession
    folder = f"{session_folder(spark, 'stream-input')}/rows"
    counts = df.agg(*[F.count_if(F.expr(c)) for c in conditions]).first()
    each = max(1, -(-max(counts) // file_rows))
    for i, condition in enumerate(conditions, 1):
        rows = df.where(condition)
        (rows.coalesce(1) if each == 1 else rows.repartition(each)).write.mode("append").parquet(folder)
        for _ in range(len(names(spark, folder)), i * each):
            df.limit(0).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(folder)


def closed(df: DataFrame, host: str = "host", ts: str = "ts") -> DataFrame:
    """``df`` and the closing row."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    values = {host: F.lit(CLOSING).cast(kinds[host]), ts: F.expr(LATER).cast(kinds[ts])}
    row = df.sparkSession.range(1).select(*[values.get(n, F.lit(None).cast(k)).alias(n) for n, k in kinds.items()])
    return df.unionByName(row)


@query(
    "stream_assemble",
    """SELECT c_custkey AS host, c_acctbal AS load,
      coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F'), '') AS disks,
      coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'O'), '') AS network,
      count(*) FILTER (WHERE o_orderstatus = 'P') AS processes,
      count(DISTINCT o_orderstatus) = 3 AS complete
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""",
)
def stream_assemble_(spark, folder):
    """Customers as hosts, their orders by status as three more collectors' lists; parts come in different orders, some never."""
    at = (F.timestamp_seconds(F.col("host") + 1_700_000_000)).alias("ts")
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "host")

    def of(status, name):
        mine = orders.where(F.col("o_orderstatus") == status).groupBy("host")
        return mine.agg(F.sort_array(F.collect_list("o_orderkey")).alias(name)).select("host", at, name)

    load = table(spark, folder, "customer").select(F.col("c_custkey").alias("host"), F.col("c_acctbal").alias("load"))
    parts = {"load": load.select("host", at, "load"), "disks": of("F", "disks"), "network": of("O", "network"), "processes": of("P", "processes")}
    even, odd, end = "host >= 0 and host % 2 = 0", "host % 2 = 1", f"host = {CLOSING}"
    streams = {n: in_files(closed(df), *((even, odd) if i % 2 else (odd, even)), end) for i, (n, df) in enumerate(parts.items())}
    found = landed(stream_assemble(streams, wait="3650 days")).where(F.col("host") != CLOSING)

    def listed(name):
        return F.coalesce(F.array_join(name, ","), F.lit("")).alias(name)

    processes = F.coalesce(F.size("processes"), F.lit(0)).cast("bigint").alias("processes")
    return found.select("host", "load", listed("disks"), listed("network"), processes, "complete")


@query("stream_as_of", AS_OF_SQL)
def stream_as_of_(spark, folder):
    """Both sides in files that are out of order."""
    left, right, values, more = as_of_sides(spark, folder)
    odd, even, end = "host <> -1 and day(ts) % 2 = 1", "host <> -1 and day(ts) % 2 = 0", f"host = {CLOSING}"
    sides = [in_files(closed(side), *order, end) for side, order in ((left, (odd, even)), (right, (even, odd)))]
    found = landed(stream_as_of(*sides, values, late="3650 days", **more))
    return found.where(F.col("host") != CLOSING).drop("late")


@query("stream_containers", f"SELECT *, ts AS created FROM {CONTAINERS_SQL}")
def stream_containers_(spark, folder):
    """Container lists and stats documents as JSON lines, through the container reader."""
    listed, stats = container_tables(spark, folder)
    paths = []
    for df in (listed, stats):
        path = f"{session_folder(spark, 'containers')}/lines"
        for condition in (f"host <> '{CLOSING}'", f"host = '{CLOSING}'"):
            closed(df).where(condition).write.mode("append").json(path)
        paths.append(path)
    found = landed(stream_containers(*read_containers(spark, *paths, streaming=True)))
    return found.where(F.col("host") != str(CLOSING))


@query("container_source", f"SELECT *, ts AS created FROM {CONTAINERS_SQL}")
def container_source(spark, folder):
    """Container lists and stats documents written as JSON lines, read by the container reader and joined."""
    paths = []
    for df in container_tables(spark, folder):
        paths.append(f"{session_folder(spark, 'containers')}/lines")
        df.write.json(paths[-1])
    found = containers(*read_containers(spark, *paths))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "created")})


@query("stream_backfill", BACKFILL_DEDUPE_SQL)
def stream_backfill_(spark, folder):
    backfill, live = backfill_and_live(spark, folder)
    end = f"host = {CLOSING}"
    early, late = f"host <> {CLOSING} and event_id % 3 = 0", f"host <> {CLOSING} and event_id % 3 <> 0"
    streams = [in_files(closed(side), *order, end) for side, order in ((backfill, (early, late)), (live, (late, early)))]
    points = landed(stream_backfill(*streams, seq=["event_id"], late="3650 days")).where(F.col("host") != CLOSING)
    return tail(points, 20, seq=["event_id"])
