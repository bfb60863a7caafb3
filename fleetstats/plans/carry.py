"""Rates of tables that come run by run, with each key's last sample kept in between."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from fleetstats.operators.rates import counter_rate
from fleetstats.operators.series import latest
from fleetstats.plans import files


def _runs(spark, store: str) -> list[str]:
    """Runs in their order, each ``<number>-<name>``."""
    return files.names(spark, f"{store}/runs")


def carried_samples(spark, store: str, run: str | None = None) -> DataFrame | None:
    """The last sample of each key before a run, or of all runs; None before the first."""
    done = _runs(spark, store)
    if run is not None:
        own = [i for i, n in enumerate(done) if n.split("-", 1)[1] == run]
        done = done[: own[0]] if own else done
    return spark.read.parquet(f"{store}/last/{done[-1]}") if done else None


def counter_rate_run(
    df: DataFrame,
    store: str,
    run: str,
    counters: Sequence[str] = ("bytes_sent", "bytes_recv"),
    keys: Sequence[str] = ("host", "name"),
    ts: str = "ts",
    seq: Sequence[str] = (),
    **options,
) -> DataFrame:
    """``counter_rate`` of one run's samples; each key's first takes its rate from the last sample of the runs before.

    The last sample of each key is merged with those carried so far and written to ``store`` as this run's version; earlier versions
    stay.  A run that is repeated, by its name, starts from the version that it started from the first time and
    gives the same rows, so a failed job can simply be run again.  Runs follow each other in time; a sample older than what
    was carried for its key comes first in its key's order, with rate 0.
    """
    spark = df.sparkSession
    if "/" in run:
        raise ValueError("the name of a run has no slash")
    own = [n for n in _runs(spark, store) if n.split("-", 1)[1] == run]
    carried = carried_samples(spark, store, run)
    samples = df.select(*dict.fromkeys([*keys, ts, *seq, *counters]))
    if not own:
        both = samples if carried is None else samples.unionByName(carried)
        version = f"{len(_runs(spark, store)):08}-{run}"
        latest(both, keys, ts, seq).write.mode("overwrite").parquet(f"{store}/last/{version}")
        files.write(spark, f"{store}/runs/{version}")
    return counter_rate(df, counters, keys, ts, seq, carried=carried, **options)
