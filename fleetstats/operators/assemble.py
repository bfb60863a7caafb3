"""Joining the parts of a snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetstats.plans.slices import join_same

TICK = ("host", "ts")


def ordered_list(order: Sequence[str], item: Column) -> Column:
    """Aggregate: the group's items as an array in the given order."""
    pairs = F.sort_array(F.collect_list(F.struct(*order, item.alias("_item"))))
    return F.transform(pairs, lambda pair: pair["_item"])


def join_addrs(
    addrs: DataFrame,
    keys: Sequence[str] = (*TICK, "name"),
    addr: str = "addr",
    seq: Sequence[str] = ("seq",),
    name: str = "addrs",
) -> DataFrame:
    """One text per interface: its addresses in listed order, joined by ``', '``."""
    joined = F.array_join(ordered_list(seq, F.col(addr)), ", ")
    return addrs.groupBy(*keys).agg(joined.alias(name))


def with_addrs(
    interfaces: DataFrame,
    addrs: DataFrame,
    keys: Sequence[str] = (*TICK, "name"),
    addr: str = "addr",
    seq: Sequence[str] = ("seq",),
    name: str = "addrs",
) -> DataFrame:
    """Interfaces with their address text, empty where none is known."""
    texts = join_addrs(addrs, keys, addr, seq, name)
    return join_same(interfaces, texts, keys, "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(""))
    )


def first_per_device(
    partitions: DataFrame,
    keys: Sequence[str] = TICK,
    device: str = "device",
    seq: Sequence[str] = ("seq",),
) -> DataFrame:
    """The first listed partition of each device of a tick."""
    listed = Window.partitionBy(*keys, device).orderBy(*seq)
    return (
        partitions.withColumn("_place", F.row_number().over(listed))
        .where("_place = 1")
        .drop("_place")
    )


def usable(df: DataFrame, total: str = "total") -> DataFrame:
    """Filesystems with a known size above nothing."""
    return df.where(F.col(total).isNotNull() & (F.col(total) != 0))


def disk_usage(
    partitions: DataFrame,
    usage: DataFrame,
    keys: Sequence[str] = TICK,
    device: str = "device",
    mountpoint: str = "mountpoint",
    seq: Sequence[str] = ("seq",),
    total: str = "total",
) -> DataFrame:
    """Usage of each device.

    The first partition of a device stands for it before usability is looked at, so a device whose
    first mount is unusable is absent even when a later mount is usable.
    """
    first = first_per_device(partitions, keys, device, seq)
    return usable(join_same(first, usage, [*keys, mountpoint]), total)


def process_table(
    pids: DataFrame,
    attributes: Mapping[str, DataFrame],
    statuses: DataFrame | None = None,
    keys: Sequence[str] = (*TICK, "pid"),
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """Processes with their attributes, each attribute table holding one row per key.

    ``attributes`` maps a column to the table that has it; ``statuses`` has an array ``statuses``,
    of which the first counts.  A missing attribute takes its default and never loses the process.
    """
    defaults = {"name": "", "cpu": 0.0, "mem": 0.0, "status": "", **(defaults or {})}
    tables = {name: table.select(*keys, name) for name, table in attributes.items()}
    if statuses is not None:
        tables["status"] = statuses.select(*keys, F.get("statuses", F.lit(0)).alias("status"))
    joined = reduce(lambda df, table: join_same(df, table, keys, "left"), tables.values(), pids)
    return joined.withColumns(
        {name: F.coalesce(F.col(name), F.lit(defaults[name])) for name in tables if name in defaults}
    )


def assemble(
    single: Mapping[str, DataFrame],
    lists: Mapping[str, tuple[DataFrame, Sequence[str]]],
    keys: Sequence[str] = TICK,
) -> DataFrame:
    """One row per tick from tables collected apart.

    ``single`` maps a column to a table with one row per tick, ``lists`` to a table and its listing
    order.  All columns of a table but the keys (and, for lists, columns starting with ``_``) become
    the fields of a struct.  A tick any table knows is kept; a table that lacks it gives NULL, or an
    empty list.  The tables are stacked and grouped once, which is one shuffle for all of them where
    a chain of full outer joins would shuffle the growing row at every step.
    """

    def fields(table: DataFrame) -> Column:
        return F.struct(*[c for c in table.columns if c not in keys and not c.startswith("_")])

    parts, columns = [], []
    for name, table in single.items():
        parts.append(table.select(*keys, fields(table).alias(name)))
        columns.append(F.first(name, ignorenulls=True).alias(name))
    for name, (table, order) in lists.items():
        entry = F.struct(
            F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)]).alias("order"),
            fields(table).alias("item"),
        )
        parts.append(table.select(*keys, entry.alias(name)))
        in_order = F.sort_array(F.collect_list(name))
        columns.append(F.transform(in_order, lambda e: e["item"]).alias(name))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(*keys).agg(*columns)
