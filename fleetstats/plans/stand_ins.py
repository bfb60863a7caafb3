"""How the tables at hand stand in for telemetry, in Spark and in SQL.

``events`` are samples: the user is the host, the event type the interface, and the ``k`` property a
counter that often goes back.  ``orders`` are containers or partitions with ``lineitem`` totals as
their stats, customers are hosts, and embeddings are per-core readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.plans.catalog import table

LOOPBACK = "view"


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("host"),
        F.col("event_type").alias("name"),
        "ts",
        "event_id",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


SAMPLES = """(SELECT user_id AS host, event_type AS name, ts, event_id, value,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def cents(amount: str | Column) -> Column:
    column = F.col(amount) if isinstance(amount, str) else amount
    return F.round(column * 100).cast("bigint")


def order_totals(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.sum(cents("l_extendedprice")).alias("spent"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
            F.count("*").alias("lines"),
        )
    )


ORDER_TOTALS = """(SELECT l_orderkey AS id,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS spent,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS lines
    FROM lineitem GROUP BY l_orderkey)"""


def sql_fixed(x: str, digits: int) -> str:
    moved = f"abs({x}) + {0.1 * 10.0**-digits!r}"
    tie = f"fmod(abs({x}) * {2 ** (digits + 1)}, 2) = 1"
    return (
        f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || "
        f"printf('%.{digits}f', CASE WHEN {tie} THEN {moved} ELSE abs({x}) END))"
    )


def _sql_ladder(x: str, units: tuple[str, ...]) -> str:
    branches = " ".join(
        f"WHEN {x} >= {1024**p} THEN {sql_fixed(f'({x} / {1024**p})', 1)} || ' {units[p]}'"
        for p in range(len(units) - 1, 0, -1)
    )
    return f"(CASE {branches} ELSE {sql_fixed(x, 0)} || ' {units[0]}' END)"


def sql_bytes(x: str) -> str:
    return _sql_ladder(f"CAST({x} AS DOUBLE)", ("B", "KB", "MB", "GB", "TB"))


def sql_rate(x: str) -> str:
    return _sql_ladder(f"greatest({x}, 0.0)", ("B/s", "KB/s", "MB/s"))


def sql_class(x: str, names: tuple[str, str, str], high: float, low: float, op: str = ">=") -> str:
    return f"CASE WHEN {x} {op} {high} THEN '{names[0]}' WHEN {x} {op} {low} THEN '{names[1]}' ELSE '{names[2]}' END"


PCT_CLASS = ("crit", "warn", "")
COLORS = ("red", "yellow", "green")
PROC_COLORS = ("red", "yellow", "")
