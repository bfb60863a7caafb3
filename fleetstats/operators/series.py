"""History: points, rolling tails, latest rows, ticks and chart series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetstats.functions.times import ts_to_s
from fleetstats.plans.slices import HOT_ROWS, NO_TIME, PIECES_PER_TASK, SLICE, join_same, slice_start, to_micros
from fleetstats.plans.staging import stage

HISTORY_POINTS = 3600  # points kept per host by default
TASK_ROWS = 500_000  # rows of many hosts that one task sorts


def history_points(
    snapshots: DataFrame, cpu: str = "cpu.avgUsage", mem: str = "memory.usedPercent",
    keys: Sequence[str] = ("host",), ts: str = "ts",
) -> DataFrame:
    """One history point per snapshot."""
    return snapshots.select(
        *keys, ts, F.col(cpu).alias("cpu_avg"), F.col(mem).alias("mem_percent")
    )


def tail(
    df: DataFrame,
    n: int = HISTORY_POINTS,
    keys: Sequence[str] = ("host",),
    ts: str = "ts",
    seq: Sequence[str] = (),
    since: Column | None = None,
    width: str = SLICE,
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
    date: str | None = None,
) -> DataFrame:
    """The last ``n`` rows per host; ``since`` further leaves out rows before a time.

    A first pass counts rows per host; if no host has more than ``n``, that is all.  Two more read only keys and time: one finds how
    wide slices have to be for about 16 rows in each, at least ``width``, the other counts
    rows per (host, slice), which combines before the shuffle.  From the counts follows the oldest slice of each host that can hold
    one of its last ``n`` rows.  The last pass reads no older ones: the oldest start bounds the scan, the
    staged table of starts, a row per host, filters it, and only the rows left are sorted, ``TASK_ROWS`` or so a task.
    Should a host have more rows in one slice than a task may sort, they are first cut to ``n`` per part of a random split.

    ``counts`` may give the rows per host and ``_slice`` of this ``width`` as ``_rows``, as ``streaming.tables.LandedTable`` keeps
    them; then there is no pass before the last.  ``date`` names a column with the day of ``ts`` by which the table is laid out;
    folders of days before the oldest slice are then not listed.
    """
    rows = df if since is None else df.where(F.col(ts) >= since)
    if counts is None:
        width = _sparse_width(rows, n, keys, ts, width)
        if width is None:
            return rows
    sliced = rows.withColumn("_slice", slice_start(ts, width))
    if counts is None:
        counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_rows"))
    newer = (
        Window.partitionBy(*keys)
        .orderBy(F.desc("_slice"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    needed = F.when(F.col("_newer") < n, F.col("_rows"))
    hosts = stage(
        counts.withColumn("_newer", F.coalesce(F.sum("_rows").over(newer), F.lit(0)))
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("_newer") < n, F.col("_slice"))).alias("_from"),
            F.max(needed).alias("_largest"),
            F.sum(needed).alias("_kept"),
        ),
        "tail-slices",
    )
    start, largest, total = hosts.agg(F.min("_from"), F.max("_largest"), F.sum("_kept")).first()
    if start is not None and start != NO_TIME:
        bound = F.timestamp_micros(F.lit(start)).cast(df.schema[ts].dataType)
        sliced = sliced.where(F.col(ts) >= bound)
        if date is not None:
            sliced = sliced.where(F.col(date) >= bound.cast("date"))
    kept = join_same(sliced, hosts.select(*keys, "_from"), keys, "left_semi", F.col("_slice") >= F.col("_from")).drop("_slice")
    newest = [F.desc(ts), *[F.desc(s) for s in seq]]
    if largest is not None and largest > hot_rows:
        parts = -(-largest * PIECES_PER_TASK // hot_rows)
        # Maps have no hash.
        plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        part = F.pmod(F.xxhash64(ts, *(seq or plain)), F.lit(parts))
        kept = _first_rows(kept.withColumn("_part", part), n, [*keys, "_part"], newest).drop("_part")
    if total is not None and total > TASK_ROWS:
        # Left to AQE, a task may get all rows that fit its size when compressed.
        kept = kept.repartition(-(-total // TASK_ROWS), *keys)
    return _first_rows(kept, n, keys, newest)


def _sparse_width(rows: DataFrame, n: int, keys: Sequence[str], ts: str, width: str) -> str | None:
    """``width``, widened until there are about 16 times fewer slices than rows; None if no host has more than ``n`` rows."""
    hosts = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    largest, total = hosts.agg(F.max("_rows"), F.sum("_rows")).first()
    if largest is None or largest <= n:
        return None
    widths = [f"{to_micros(width) * 8**i} microseconds" for i in range(5)]
    slices = rows.agg(*[F.approx_count_distinct(F.xxhash64(*keys, slice_start(ts, w))) for w in widths]).first()
    return next((w for w, s in zip(widths, slices) if s * 16 <= total), widths[-1])


def _first_rows(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def latest(
    df: DataFrame,
    keys: Sequence[str] = ("host",),
    ts: str = "ts",
    seq: Sequence[str] = (),
) -> DataFrame:
    """The newest row per host, in one pass: each task keeps one row per host before the shuffle."""
    return _first_rows(df, 1, keys, [F.desc(ts), *[F.desc(s) for s in seq]])


def backfill_union(
    backfill: DataFrame,
    live: DataFrame,
    n: int = HISTORY_POINTS,
    dedupe: bool = False,
    keys: Sequence[str] = ("host",),
    ts: str = "ts",
    seq: Sequence[str] = (),
    width: str = SLICE,
) -> DataFrame:
    """Replayed history and live points together, cut to the last ``n`` per host.

    At equal times the live point counts as the newer.  ``dedupe`` keeps one point per host and
    time, the live one where both have it.
    """
    both = backfill.withColumn("_live", F.lit(0)).unionByName(live.withColumn("_live", F.lit(1)))
    if dedupe:
        same = Window.partitionBy(*keys, ts).orderBy(F.desc("_live"), *[F.desc(s) for s in seq])
        both = (
            both.withColumn("_copy", F.row_number().over(same)).where("_copy = 1").drop("_copy")
        )
    return tail(both, n, keys, ts, (*seq, "_live"), width=width).drop("_live")


def extent(df: DataFrame, keys: Sequence[str] = ("host",), ts: str = "ts") -> DataFrame:
    """First and last time per host in epoch seconds, the range between (at least 1), and points."""
    at = ts_to_s(ts)
    return (
        df.groupBy(*keys)
        .agg(F.min(at).alias("t_min"), F.max(at).alias("t_max"), F.count(ts).alias("points"))
        .withColumn("t_range", F.greatest(F.col("t_max") - F.col("t_min"), F.lit(1)))
    )


def trend(
    df: DataFrame,
    values: Sequence[str] = ("cpu_avg", "mem_percent"),
    keys: Sequence[str] = ("host",),
    ts: str = "ts",
) -> DataFrame:
    """Chart-ready points: ``x`` and each ``<value>_y`` in [0, 1]; hosts with one point have none.

    A missing reading stays missing.
    """
    drawn = stage(extent(df, keys, ts).where(F.col("points") >= 2), "extents")
    return join_same(df, drawn, keys).select(
        *df.columns,
        ((ts_to_s(ts) - F.col("t_min")) / F.col("t_range")).alias("x"),
        *[
            F.when(F.col(v).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(v))) / 100.0).alias(f"{v}_y")
            for v in values
        ],
    )


def sample(
    df: DataFrame,
    every: str = "1500 milliseconds",
    values: Sequence[str] = ("cpu_avg", "mem_percent"),
    keys: Sequence[str] = ("host",),
    ts: str = "ts",
    seq: Sequence[str] = (),
) -> DataFrame:
    """One point per tick: the newest values of each window of length ``every``, batch or stream.

    Without ``seq`` the order is a plain time, which keeps the aggregation hash-based.
    """
    order = F.struct(ts, *seq) if seq else F.col(ts)
    return (
        df.groupBy(*keys, F.window(ts, every).alias("_tick"))
        .agg(*[F.max_by(v, order).alias(v) for v in values])
        .select(*keys, F.col("_tick.start").alias("tick"), *values)
    )
