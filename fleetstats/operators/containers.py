"""Container metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstats.functions.labels import container_name, container_state, dash, state_badge
from fleetstats.functions.numbers import mem_text, to_fixed
from fleetstats.functions.times import fmt_datetime, s_to_ts
from fleetstats.plans.slices import HOT_ROWS, with_previous

RUNNING = "running"


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cpu_pct(cpu_delta: str | Column, system_delta: str | Column, online: str | Column) -> Column:
    """Share of the system's CPU time times the online CPUs, in percent.

    0 where the system time did not advance, no CPU is online, or the container's counter went back.
    """
    used, system, cpus = (_column(c).cast("double") for c in (cpu_delta, system_delta, online))
    sound = (system > 0) & (cpus > 0) & (used >= 0)
    return F.when(sound, used / system * cpus * 100.0).otherwise(F.lit(0.0))


def container_cpu_pct(
    df: DataFrame,
    cpu_delta: str | Column,
    system_delta: str | Column,
    online: str | Column,
    name: str = "cpu_pct",
) -> DataFrame:
    return df.withColumn(name, cpu_pct(cpu_delta, system_delta, online))


def container_stats(
    stats: DataFrame,
    baseline: str = "embedded",
    keys: Sequence[str] = ("host", "id"),
    ts: str = "ts",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Stats documents as columns ``cpu_pct``, ``mem_usage`` and ``mem_limit``.

    ``baseline='embedded'`` measures against the earlier sample inside each document;
    ``baseline='poll'`` against the container's previous document, for daemons that leave the
    embedded one empty.  A first poll has no baseline and reads 0.
    """
    if baseline not in ("embedded", "poll"):
        raise ValueError("baseline is 'embedded' or 'poll'")

    def counter(path: str) -> Column:
        return F.expr(f"try_cast({path} AS bigint)")

    flat = stats.select(
        *keys,
        ts,
        counter("cpu_stats.cpu_usage.total_usage").alias("_cpu"),
        counter("cpu_stats.system_cpu_usage").alias("_system"),
        F.col("cpu_stats.online_cpus").alias("_online"),
        F.coalesce(counter("precpu_stats.cpu_usage.total_usage"), F.lit(0)).alias("_cpu_before"),
        F.coalesce(counter("precpu_stats.system_cpu_usage"), F.lit(0)).alias("_system_before"),
        counter("memory_stats.usage").alias("mem_usage"),
        counter("memory_stats.limit").alias("mem_limit"),
    )
    if baseline == "poll":
        flat = with_previous(
            flat.drop("_cpu_before", "_system_before"),
            keys,
            ts,
            {"_cpu_before": "_cpu", "_system_before": "_system"},
            hot_rows=hot_rows,
        )
    share = cpu_pct(
        F.col("_cpu") - F.col("_cpu_before"), F.col("_system") - F.col("_system_before"), "_online"
    )
    return flat.select(*keys, ts, share.alias("cpu_pct"), "mem_usage", "mem_limit")


def container_metrics(
    containers: DataFrame,
    stats: DataFrame,
    metrics: Sequence[str] = ("cpu_pct", "mem_usage", "mem_limit"),
    keys: Sequence[str] = ("host", "ts", "id"),
    state: str = "state",
    running: str = RUNNING,
) -> DataFrame:
    """Every container, with metrics where it is running and has stats, and zeros otherwise."""
    s = stats.select(*[F.col(k).alias(f"_{k}") for k in keys], *metrics)
    matched = F.col(state) == running
    for k in keys:
        matched = matched & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return with_zeros(containers.join(s, matched, "left").drop(*[f"_{k}" for k in keys]), metrics)


def with_zeros(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Missing metrics as zeros."""
    return df.withColumns({m: F.coalesce(F.col(m), F.lit(0).cast(df.schema[m].dataType)) for m in metrics})


def named_containers(listed: DataFrame) -> DataFrame:
    """Container lists with the names of the landed table."""
    return listed.select(
        "host",
        "ts",
        F.col("Id").alias("id"),
        container_name("Names").alias("name"),
        F.col("Image").alias("image"),
        F.col("State").alias("state"),
        F.col("Status").alias("status"),
        s_to_ts("Created").alias("created"),
    )


def containers(listed: DataFrame, stats: DataFrame, baseline: str = "embedded") -> DataFrame:
    """The landed containers table from container lists and stats documents."""
    measured = container_metrics(named_containers(listed), container_stats(stats, baseline))
    return measured.select(
        "host", "ts", "id", "name", "image", "state", "status",
        "cpu_pct", "mem_usage", "mem_limit", "created",
    )


def shown_cpu(state: str | Column, percent: str | Column, running: str = RUNNING) -> Column:
    """CPU text of a running container, ``-`` for any other."""
    text = F.concat(to_fixed(percent, 1), F.lit("%"))
    return F.when(_column(state) == running, text).otherwise("-")


def shown_memory(
    state: str | Column, used: str | Column, limit: str | Column, running: str = RUNNING
) -> Column:
    """Memory text of a running container that uses any, ``-`` otherwise."""
    in_use = (_column(state) == running) & (_column(used) > 0)
    return F.when(in_use, mem_text(used, limit)).otherwise("-")


def container_report(df: DataFrame) -> DataFrame:
    return df.select(
        "host",
        "ts",
        "id",
        dash("name").alias("name_text"),
        dash("image").alias("image_text"),
        container_state("state").alias("state_text"),
        state_badge("state").alias("badge"),
        dash("status").alias("status_text"),
        shown_cpu("state", "cpu_pct").alias("cpu_text"),
        shown_memory("state", "mem_usage", "mem_limit").alias("mem_text"),
        fmt_datetime("created").alias("created_text"),
    )
