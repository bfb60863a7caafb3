"""As-of alignment of sources that tick at different times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetstats.plans.slices import HOT_ROWS, cut, hot_keys, join_same


def _filled(asked: DataFrame, known: DataFrame, by: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """The asked rows with the newest known value of their group, as ``_near``."""
    forward = (
        Window.partitionBy(*by)
        .orderBy("_at", "_side", *marks[1:])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        asked.unionByName(known, allowMissingColumns=True)
        .withColumn("_near", F.last("_value", ignorenulls=True).over(forward))
        .where("_side = 1")
        .select(*asked.columns, "_near")
    )


def _filled_within_pieces(
    asked: DataFrame, known: DataFrame, keys: Sequence[str], marks: Sequence[str]
) -> DataFrame:
    """As ``_filled`` for keys cut into pieces.

    A row ahead of its piece's first known value takes the one carried in from earlier pieces, of
    which there is one per piece.
    """
    near = _filled(asked, known, [*keys, "_piece"], marks)
    earlier = (
        Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    newest = F.struct(*marks) if len(marks) > 1 else F.col("_at")
    closing = known.groupBy(*keys, "_piece").agg(F.max_by("_value", newest).alias("_value"))
    visited = asked.select(*keys, "_piece").distinct()
    carry = (
        visited.unionByName(closing, allowMissingColumns=True)
        .groupBy(*keys, "_piece")
        .agg(F.first("_value", ignorenulls=True).alias("_value"))
        .select(*keys, "_piece", F.last("_value", ignorenulls=True).over(earlier).alias("_far"))
    )
    return join_same(near, carry, [*keys, "_piece"], "left").withColumn(
        "_near", F.coalesce("_near", "_far")
    )


def as_of(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    keys: Sequence[str] = ("host",),
    ts: str = "ts",
    right_seq: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each left row with ``values`` of the newest right row of its host not after it.

    A right row without a time is not known to be before anything and matches nothing; a left row
    without a time gets NULLs.

    Both sides are stacked and values filled forward in time, in one shuffle and without comparing
    rows in pairs.
    """
    keys = list(keys)
    marks = ["_at", *[f"_seq{i}" for i in range(len(right_seq))]]
    order = [F.col(c).alias(mark) for c, mark in zip((ts, *right_seq), marks)]
    known = right.where(F.col(ts).isNotNull()).select(*keys, *order, F.struct(*values).alias("_value"), F.lit(0).alias("_side"))
    asked = left.select("*", F.col(ts).alias("_at"), F.lit(1).alias("_side"))

    hot = hot_keys(asked.select(*keys, "_at").unionByName(known.select(*keys, "_at")), keys, "_at", hot_rows)
    if hot is None:
        found = _filled(asked, known, keys, marks)
    else:
        ordinary = [join_same(side, hot, keys, "left_anti") for side in (asked, known)]
        pieces = [cut(side, hot, keys, "_at") for side in (asked, known)]
        found = _filled(*ordinary, keys, marks).unionByName(
            _filled_within_pieces(*pieces, keys, marks).drop("_piece", "_far")
        )
    return found.select(*left.columns, *[F.col(f"_near.{v}").alias(v) for v in values])
