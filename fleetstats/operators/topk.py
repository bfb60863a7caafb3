"""Process ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PROCESSES = 50
VIEWS = ("cpu", "mem", "pid")


def _order(by: str, pid: str) -> list[Column]:
    return [F.asc(pid)] if by == pid else [F.desc(by), F.asc(pid)]


def top_processes(
    df: DataFrame,
    n: int = MAX_PROCESSES,
    keys: Sequence[str] = ("host", "ts"),
    by: str = "cpu",
    pid: str = "pid",
) -> DataFrame:
    """The ``n`` busiest processes of each tick of each host, or of the whole table if ``keys`` is
    empty; equal readings go by process id.
    """
    if not keys:
        return df.orderBy(*_order(by, pid)).limit(n)
    ranked = Window.partitionBy(*keys).orderBy(*_order(by, pid))
    return (
        df.withColumn("_place", F.row_number().over(ranked)).where(F.col("_place") <= n).drop("_place")
    )


def sort_view(
    top: DataFrame, by: str = "cpu", keys: Sequence[str] = ("host", "ts"), pid: str = "pid"
) -> DataFrame:
    """Place of each process in a view of an already cut list: a view by memory re-orders the
    busiest processes and is not the list of the largest ones.
    """
    if by not in VIEWS:
        raise ValueError(f"by is one of {VIEWS}")
    shown = Window.partitionBy(*keys).orderBy(*_order(pid if by == "pid" else by, pid))
    return top.withColumn("rank", F.row_number().over(shown))


def process_counts(
    df: DataFrame, n: int = MAX_PROCESSES, keys: Sequence[str] = ("host", "ts")
) -> DataFrame:
    """Processes shown per tick, that is after the cut."""
    return df.groupBy(*keys).agg(F.least(F.count("*"), F.lit(n)).alias("shown"))


def counts(df: DataFrame, keys: Sequence[str] = ("host", "ts"), name: str = "rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))
