"""Registry of the catalogue: each query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query over the tables of a folder, and its SQL where it has one."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from fleetstats.plans import (  # noqa: F401
        catalog_joins,
        catalog_messages,
        catalog_series,
        catalog_stream_joins,
        catalog_streams,
        catalog_texts,
    )

    return QUERIES, ORACLES
