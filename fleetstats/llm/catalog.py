"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query over the tables of a folder, and its SQL where it has one."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from fleetstats.llm import (  # noqa: F401
        bpe,
        conversations,
        exact_dedup,
        hard_negatives,
        mixing,
        near_dedup,
        neighbours,
        quality,
        secrets,
        substring_dedup,
        toxicity,
        url_filters,
        warc,
    )

    import corpus_pipeline

    query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
    return dict(QUERIES), dict(ORACLES)
