"""From raw documents to token ids: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, folder) and returns a DataFrame; all but the last return the columns of ``documents``.
Between stages the documents are written and read again, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from fleetstats.llm.catalog import table
from fleetstats.plans.staging import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Target shares by language are the natural ones to this power, so rarer languages are repeated more.
TEMPERATURE = 0.7


def toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score as toxic go; labels of the ``labels`` table that are not held out teach the score."""
    return toxicity.drop_toxic(docs, table(spark, folder, "labels"))


def exact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays, one row of it."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near duplicates (five words a shingle, similarity 0.8) the smallest id stays."""
    return near_dedup.drop_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents are repeated until their languages have their target shares of tokens.

    No rate is under one, so every document stays, and the corpus grows until the most frequent language has only its share;
    rows of rarer languages are there more than once.
    """
    labelled = mixing.labelled_languages(spark, docs, folder)
    return mixing.mix(docs, labelled, temperature=TEMPERATURE, least=1.0, grow=True)


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each row's token ids, as packed 32-bit integers, with digests of them and of the text they decode to."""
    ids = bpe.encode_and_decode(docs, keep=("doc_id", "lang", "source"))
    return ids.select(
        "doc_id", "lang", "source", bpe.n_tokens("ids").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("bpe", encoded),
]

# Learnt scores, similarity joins and tokens are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the folder's ``documents``."""
    docs = table(spark, folder, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
