"""Nested snapshots to flat tables, and the report columns of those tables.

Arrays are unnested in place (no shuffle), and a report reads only the nested fields it names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NumericType, StringType, StructType

from fleetstats.functions.labels import (
    dash,
    load_color,
    pct_class,
    pct_color,
    proc_color,
    status_label,
)
from fleetstats.functions.numbers import fmt_bytes, fmt_rate, mem_text, to_fixed
from fleetstats.functions.times import fmt_uptime

SNAPSHOT_KEYS = ("host", "ts")
LOOPBACK = ("lo",)


def mean_of(values: str | Column) -> Column:
    """Unweighted mean of an array; 0 for a missing or empty one."""
    array = F.col(values) if isinstance(values, str) else values
    total = F.aggregate(array, F.lit(0.0), lambda sum_, x: sum_ + x.cast("double"))
    return F.when(F.size(array) > 0, total / F.size(array)).otherwise(F.lit(0.0))


def cpu_avg(df: DataFrame, usage: str = "cpu.usage", name: str = "cpu_avg") -> DataFrame:
    return df.withColumn(name, mean_of(usage))


def cpu_cores(
    df: DataFrame,
    usage: str = "cpu.usage",
    keys: Sequence[str] = SNAPSHOT_KEYS,
    outer: bool = False,
) -> DataFrame:
    """One row per core: its index from 0 and its percent.  ``outer`` keeps hosts without cores."""
    unnest = F.posexplode_outer if outer else F.posexplode
    return df.select(*keys, unnest(usage).alias("core", "percent")).withColumn(
        "percent", F.col("percent").cast("double")
    )


def cpu_core_report(cores: DataFrame) -> DataFrame:
    return cores.withColumns(
        {
            "percent_text": F.concat(to_fixed("percent", 0), F.lit("%")),
            "percent_class": pct_class("percent"),
        }
    )


def unnest(df: DataFrame, array: str, keys: Sequence[str] = SNAPSHOT_KEYS) -> DataFrame:
    """One row per element of an array of structs, the element's fields as columns.

    A missing array is an empty one: it gives no rows.  Fields nobody asks for are not read.
    """
    return df.select(*keys, F.explode(array).alias("_element")).select(*keys, "_element.*")


def disks(df: DataFrame, array: str = "disks", keys: Sequence[str] = SNAPSHOT_KEYS) -> DataFrame:
    return unnest(df, array, keys).withColumnRenamed("usedPercent", "used_percent")


def disk_report(disks: DataFrame) -> DataFrame:
    return disks.withColumns(
        {
            "total_text": fmt_bytes("total"),
            "used_text": fmt_bytes("used"),
            "free_text": fmt_bytes("free"),
            "percent_text": F.concat(to_fixed("used_percent", 1), F.lit("%")),
            "percent_color": pct_color("used_percent"),
            "bar_class": pct_class("used_percent"),
        }
    )


def interfaces(
    df: DataFrame, array: str = "network", keys: Sequence[str] = SNAPSHOT_KEYS
) -> DataFrame:
    return unnest(df, array, keys).withColumnsRenamed(
        {
            "bytesSent": "bytes_sent",
            "bytesRecv": "bytes_recv",
            "sendRate": "send_rate",
            "recvRate": "recv_rate",
        }
    )


def interface_report(interfaces: DataFrame) -> DataFrame:
    return interfaces.withColumns(
        {
            "addrs": dash("addrs"),
            "sent_text": fmt_bytes("bytes_sent"),
            "recv_text": fmt_bytes("bytes_recv"),
            "send_rate_text": fmt_rate("send_rate"),
            "recv_rate_text": fmt_rate("recv_rate"),
        }
    )


def exclude_ifaces(df: DataFrame, names: Sequence[str] = LOOPBACK, name: str = "name") -> DataFrame:
    """Drop interfaces of exactly these names; an interface without a name stays."""
    return df.where(~F.coalesce(F.col(name).isin(*names), F.lit(False)))


def processes(
    df: DataFrame, array: str = "processes", keys: Sequence[str] = SNAPSHOT_KEYS
) -> DataFrame:
    return unnest(df, array, keys)


def process_report(processes: DataFrame) -> DataFrame:
    return processes.withColumns(
        {
            "cpu_text": to_fixed("cpu", 1),
            "cpu_color": proc_color("cpu"),
            "mem_text": to_fixed("mem", 1),
            "mem_color": proc_color("mem"),
            "status_text": status_label("status"),
        }
    )


def core_text(cores: str | Column, threads: str | Column) -> Column:
    count = [
        F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("0"))
        for c in (cores, threads)
    ]
    return F.concat(count[0], F.lit("C/"), count[1], F.lit("T"))


def slash_text(*parts: str | Column) -> Column:
    """Parts joined by `` / ``; a missing part is empty but keeps its place."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws(" / ", *[F.coalesce(c, F.lit("")) for c in columns])


def swap_section(total: str | Column, value: Column) -> Column:
    """A swap column, present only where the host has swap."""
    return F.when((F.col(total) if isinstance(total, str) else total) > 0, value)


def host_overview(df: DataFrame, keys: Sequence[str] = SNAPSHOT_KEYS) -> DataFrame:
    """System, CPU, memory and load of each snapshot as report columns."""
    loads = {
        f"{name}{suffix}": column
        for name in ("load1", "load5", "load15")
        for suffix, column in (
            ("_text", to_fixed(f"load.{name}", 2)),
            ("_color", load_color(f"load.{name}", "cpu.threads")),
        )
    }
    columns = {
        "hostname": F.col("system.hostname"),
        "platform_text": slash_text("system.platform", "system.kernel", "system.arch"),
        "uptime_text": F.concat(F.lit("up "), fmt_uptime("system.uptime")),
        "runtime_version": F.col("system.goVersion"),
        "cpu_model": dash("cpu.model"),
        "cpu_text": core_text("cpu.cores", "cpu.threads"),
        "cpu_avg_text": to_fixed("cpu.avgUsage", 1),
        "cpu_color": pct_color("cpu.avgUsage"),
        "mem_percent_text": to_fixed("memory.usedPercent", 1),
        "mem_color": pct_color("memory.usedPercent"),
        "mem_class": pct_class("memory.usedPercent"),
        "mem_used": fmt_bytes("memory.used"),
        "mem_free": fmt_bytes("memory.available"),
        "mem_total": fmt_bytes("memory.total"),
        "mem_text": mem_text("memory.used", "memory.total"),
        "swap_used": swap_section("memory.swapTotal", fmt_bytes("memory.swapUsed")),
        "swap_total": swap_section("memory.swapTotal", fmt_bytes("memory.swapTotal")),
        "swap_percent": swap_section("memory.swapTotal", to_fixed("memory.swapPercent", 0)),
        "swap_class": swap_section("memory.swapTotal", pct_class("memory.swapPercent")),
        **loads,
    }
    return df.select(*keys, *[column.alias(name) for name, column in columns.items()])


def _zero_form(value: Column, kind: DataType) -> Column:
    if isinstance(kind, NumericType):
        return F.coalesce(value, F.lit(0).cast(kind))
    if isinstance(kind, StringType):
        return F.coalesce(value, F.lit(""))
    if isinstance(kind, StructType):
        return F.struct(*[_zero_form(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (NumericType, StringType, StructType, ArrayType)):
        return F.transform(value, lambda item: _zero_form(item, kind.elementType))
    return value


def zero_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing numbers become 0 and missing texts empty: the wire form of an unknown value.

    Structs, also missing ones, and the items of arrays are filled within.  A missing array stays missing, as
    a list that is not there is not an empty one.
    """
    chosen = df.columns if columns is None else columns
    return df.withColumns({name: _zero_form(F.col(name), df.schema[name].dataType) for name in chosen})


def non_empty(df: DataFrame, array: str = "containers") -> DataFrame:
    """Rows whose list has entries; a missing list and an empty one are both left out."""
    return df.where(F.size(F.coalesce(F.col(array), F.array())) > 0)


def sent(df: DataFrame, array: str = "containers") -> DataFrame:
    """Rows whose list is sent at all: an empty list is sent, a missing one is not."""
    return df.where(F.col(array).isNotNull())
