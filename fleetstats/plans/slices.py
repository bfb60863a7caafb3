"""Splitting ordered per-key work when a few keys hold much of the data.

A window over ``partitionBy(key)`` puts a key's whole past into one task.  That is the cheapest plan
for keys of ordinary size and no plan at all for a key with a third of all rows.  Keys are therefore
counted first, which reads only keys and time and combines before the shuffle.  Keys above
``HOT_ROWS`` are cut into pieces by quantiles of their times, the pieces are worked on side by side, and the
few rows at the borders of pieces are then put right per key.  Results are those of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetstats.plans.staging import stage

# Rows of one key that one task may sort.
HOT_ROWS = 2_000_000
# Pieces are cut for a sixteenth of that by quantiles of time, which are approximate.
PIECES_PER_TASK = 16
# Time slices for counting: 10 minutes are 400 ticks at the default cadence of 1.5 s.
SLICE = "10 minutes"
# Rows without a time sort before all others, as NULLs do in a window.
NO_TIME = -(2**62)


def to_micros(width: str) -> int:
    return int(pd.Timedelta(width).value // 1000)


def micros(ts: str | Column) -> Column:
    """Epoch microseconds; timestamps without zone are read in the session zone (UTC)."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def slice_start(ts: str | Column, width: str = SLICE) -> Column:
    """Start of the time slice a row falls in, in epoch microseconds."""
    at = micros(ts)
    return F.coalesce(at - F.pmod(at, F.lit(to_micros(width))), F.lit(NO_TIME))


def join_same(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", also: Column | None = None
) -> DataFrame:
    """Join on equal ``keys``, where NULL equals NULL, and on ``also``, keeping the left side's keys.

    A key that is missing is a group like any other in windows and aggregates, so it is one here.
    """
    names = {k: f"_same_{k}" for k in keys}
    other = right.withColumnsRenamed(names)
    equal = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[n]) for k, n in names.items()])
    joined = left.join(other, equal if also is None else equal & also, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())


def hot_keys(
    df: DataFrame, keys: Sequence[str], ts: str, hot_rows: int = HOT_ROWS
) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows and the bounds of their pieces, or None if there are none.

    Bounds are quantiles of the key's own times, so one time far off does not stretch a piece.  Rows
    of one same time cannot be parted.  The table has at most (rows of ``df``) / ``hot_rows`` rows.
    """
    counted = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows)
    found = stage(counted, "hot-keys")
    largest = found.agg(F.max("_rows")).first()[0]
    if largest is None:
        return None
    pieces = max(2, -(-largest * PIECES_PER_TASK // hot_rows))
    shares = [i / pieces for i in range(1, pieces)]
    bounds = F.percentile_approx(micros(ts), shares, 100 * pieces)
    return stage(join_same(df, found, keys, "left_semi").groupBy(*keys).agg(bounds.alias("_bounds")), "hot-bounds")


def cut(df: DataFrame, hot: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """The rows of hot keys, each with its ``_piece``; rows without a time are ahead of the first."""
    at = micros(ts)
    piece = F.size(F.filter("_bounds", lambda bound: bound < at))
    return join_same(df, hot, keys).select(*df.columns, F.when(at.isNull(), -1).otherwise(piece).alias("_piece"))


def _lags(previous: Mapping[str, str], window) -> dict[str, Column]:
    return {name: F.lag(source).over(window) for name, source in previous.items()}


def _previous_within_pieces(
    pieces: DataFrame, keys: Sequence[str], order: list[Column], previous: Mapping[str, str]
) -> DataFrame:
    """Only first and last rows of pieces enter the pass over whole keys.

    Both branches of the union read one shared exchange.
    """
    within = Window.partitionBy(*keys, "_piece").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(*order)
    marked = pieces.withColumns(
        {
            **_lags(previous, within),
            "_first": F.lag(F.lit(True)).over(within).isNull(),
            "_last": F.lead(F.lit(True)).over(within).isNull(),
        }
    )
    settled = marked.where(~F.col("_first"))
    borders = (
        marked.where(F.col("_first") | F.col("_last"))
        .withColumns(_lags(previous, across))
        .where("_first")
    )
    return settled.unionByName(borders).drop("_piece", "_first", "_last")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    previous: Mapping[str, str],
    seq: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
    none_hot: bool = False,
) -> DataFrame:
    """Add, per key, columns of the preceding row: ``previous`` maps new name to source column.

    Equal to ``lag`` over ``partitionBy(keys).orderBy(ts, seq)``.  ``counted`` may give a cheaper
    table with the keys and times of ``df``, or more of them, to look for hot keys in; ``none_hot`` says
    that none are hot, as where a part of the keys has been counted before.
    """
    order = [F.col(ts), *map(F.col, seq)]
    whole = Window.partitionBy(*keys).orderBy(*order)
    hot = None if none_hot else hot_keys(df if counted is None else counted, keys, ts, hot_rows)
    if hot is None:
        return df.withColumns(_lags(previous, whole))
    others = join_same(df, hot, keys, "left_anti").withColumns(_lags(previous, whole))
    return others.unionByName(
        _previous_within_pieces(cut(df, hot, keys, ts), keys, order, previous)
    )
