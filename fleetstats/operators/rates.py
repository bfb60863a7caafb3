"""Cumulative counters to rates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetstats.plans.slices import HOT_ROWS, hot_keys, join_same, micros, with_previous


def elapsed_seconds(now: Column, before: Column) -> Column:
    """Seconds between two times; 1 where they do not advance."""
    gap = (micros(now) - micros(before)) / F.lit(1e6)
    return F.when(gap > 0, gap).otherwise(F.lit(1.0))


# What the rate of a counter that went back is: 0, unknown, or what it has counted since it began again at zero.
RESETS = ("clamp", "null", "restart")


def rate(now: Column, before: Column, seconds: Column, reset: str = "clamp") -> Column:
    """Growth per second: 0 for a first sample, and by ``reset`` where the counter went back."""
    change = (now - before).cast("double")
    back = {"clamp": F.lit(0.0), "null": F.lit(None).cast("double"), "restart": now.cast("double") / seconds}[reset]
    return F.when(before.isNull(), F.lit(0.0)).when(change < 0, back).otherwise(change / seconds)


def _since_last_tick(
    df: DataFrame, ticks: DataFrame | None, keys: Sequence[str], ts: str, hot_rows: int
) -> tuple[DataFrame, bool]:
    """Add ``_since``, the host's last sample time before each row, and say whether no host is hot.

    For ordinary hosts it is a window over the host, whose shuffle also serves the window over its
    counters.  Hot hosts' distinct times are cut into pieces and joined back.
    """
    seen = (df if ticks is None else ticks).select(*keys, ts)
    if hot_keys(seen, keys, ts, hot_rows) is not None:
        times = with_previous(seen.distinct(), keys, ts, {"_since": ts}, (), hot_rows, counted=seen)
        return join_same(df, times, [*keys, ts], "left"), False
    rows = df.withColumn("_asked", F.lit(True))
    if ticks is not None:
        rows = rows.unionByName(seen.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(micros(ts))
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    return rows.withColumn("_since", F.max(ts).over(earlier)).where("_asked").drop("_asked"), True


def counter_rate(
    df: DataFrame,
    counters: Sequence[str] = ("bytes_sent", "bytes_recv"),
    keys: Sequence[str] = ("host", "name"),
    ts: str = "ts",
    seq: Sequence[str] = (),
    elapsed: str = "key",
    tick_keys: Sequence[str] = ("host",),
    ticks: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    carried: DataFrame | None = None,
    reset: str = "clamp",
) -> DataFrame:
    """Add ``<counter>_rate`` per counter and ``reset``, true where any counter went back.

    The rate of a counter that went back is 0; with ``reset='null'`` it is NULL, and with ``reset='restart'`` the counter
    is taken to have begun again at zero.

    ``elapsed='key'`` divides by the time since the key's own previous sample.  ``elapsed='tick'``
    divides by the time since the host's previous sample of any key, which overstates the rate of a
    key that missed ticks; ``ticks`` may give the sample times when ``df`` lacks some of them.
    ``carried`` gives samples of an earlier run, the last of each key, so that a key's first sample here has its
    true rate; they are not in the result.
    """
    if carried is not None:
        both = df.withColumn("_carried", F.lit(False)).unionByName(
            carried.withColumn("_carried", F.lit(True)), allowMissingColumns=True
        )
        seen = ticks.unionByName(carried, allowMissingColumns=True) if ticks is not None else None
        whole = counter_rate(both, counters, keys, ts, seq, elapsed, tick_keys, seen, hot_rows, reset=reset)
        return whole.where(~F.col("_carried")).drop("_carried")
    if elapsed not in ("key", "tick"):
        raise ValueError("elapsed is 'key' or 'tick'")
    if reset not in RESETS:
        raise ValueError(f"reset is one of {RESETS}")
    previous = {f"_previous_{c}": c for c in counters}
    rows, none_hot = df, False
    if elapsed == "tick":
        rows, none_hot = _since_last_tick(df, ticks, tick_keys, ts, hot_rows)
        # A key with all of an ordinary host's rows at most is ordinary, if the host's own rows were counted.
        none_hot = none_hot and ticks is None and set(tick_keys) <= set(keys)
    else:
        previous["_since"] = ts
    rows = with_previous(rows, keys, ts, previous, seq, hot_rows, counted=df, none_hot=none_hot)
    seconds = elapsed_seconds(F.col(ts), F.col("_since"))
    went_back = [F.coalesce(F.col(c) < F.col(f"_previous_{c}"), F.lit(False)) for c in counters]
    return rows.withColumns(
        {
            **{f"{c}_rate": rate(F.col(c), F.col(f"_previous_{c}"), seconds, reset) for c in counters},
            "reset": reduce(lambda a, b: a | b, went_back),
        }
    ).drop("_since", *previous)
