"""Counts per threshold class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def severity_rollup(
    df: DataFrame, severities: Mapping[str, Column], keys: Sequence[str] = ("host",)
) -> DataFrame:
    """Rows per host, kind and class, for class columns of ``fleetstats.functions.labels`` by kind.

    All kinds are counted in one pass, and counts combine before the shuffle.
    """
    readings = [
        F.struct(F.lit(kind).alias("kind"), severity.alias("severity"))
        for kind, severity in severities.items()
    ]
    return (
        df.select(*keys, F.inline(F.array(*readings)))
        .groupBy(*keys, "kind", "severity")
        .agg(F.count("*").alias("readings"))
    )
