"""Quality by overlapping heuristic labellers.

Each labeller looks at one thing about a text and says good, bad or nothing.  Expectation-maximisation
estimates how often each is right, around the given labels, and its posterior labels train a
linear scorer on hashed word shapes, which then scores every text.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.llm.catalog import query, table
from fleetstats.llm.weak_labels import LabelModel, fit_label_model, fit_logistic, sigmoid
from fleetstats.plans.staging import stage

# Labelled documents that the scorer is fitted on at most, taken by hash.
FIT_DOCS = 8_000
HASHED = 256  # buckets for shapes, and as many again for pairs of shapes next to each other
LABEL_ERROR = 0.05
REMEMBERED = 200_000  # words whose shape a Python worker remembers
RUNS = ((re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), "X"), (re.compile(r"[^\W\d_X]+"), "x"), (re.compile(r"\d+"), "9"), (re.compile(r"(.)\1+"), r"\1"))
REPEAT = 0  # the bucket of a word that is the one before it

# What is measured for the labellers, and when each says bad and good.
MEASURES = (
    "repeated",  # share of words that are the one before them
    "symbols",  # share of characters that are neither letters, digits, white space nor common punctuation
    "capitals",  # share of ASCII letters that are upper case
    "bars",  # share of words that are a bar or a bullet
    "marks",  # share of words that end in ! or ?
    "distinct",  # distinct words among the first to last, by the root of their number
    "stops",  # share of words that end in . , ; or :
    "length",  # letters per word
)
BAD = (("repeated", ">", 0.2), ("symbols", ">", 0.05), ("capitals", ">", 0.5), ("bars", ">", 0.1), ("marks", ">", 0.3), ("distinct", "<", 1.2), ("stops", "<", 0.005), ("length", ">", 15.0))
GOOD = (("repeated", "<", 0.03), ("symbols", "<", 0.01), ("capitals", "<", 0.1), ("bars", "<", 0.02), ("marks", "<", 0.1), ("distinct", ">", 3.0), ("stops", ">", 0.03), ("length", "<", 9.0))


def shape(word: str) -> str:
    """A word with runs of capitals as X, of other letters as x, of digits as 9 and of one sign as that sign."""
    for pattern, to in RUNS:
        word = pattern.sub(to, word)
    return word[:8]


class Reader:
    """Measures and hashed shapes of texts."""

    def __init__(self) -> None:
        self.buckets = _Buckets()

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        n = max(len(words), 1)
        if len(self.buckets) > REMEMBERED:
            self.buckets.clear()
        same = np.fromiter(map(operator.eq, words[1:], words), bool, max(len(words) - 1, 0))
        at = np.fromiter(map(self.buckets.__getitem__, words), np.int64, len(words))
        at[1:][same] = REPEAT
        pairs = HASHED + (at[:-1] * 31 + at[1:] * 17) % HASHED
        hashed = np.bincount(at, minlength=HASHED)[:HASHED] / n
        hashed = np.concatenate([hashed, np.bincount(pairs - HASHED, minlength=HASHED)[:HASHED] / n])
        codes = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        capital, small = codes[65:91].sum(), codes[97:123].sum()
        plain = capital + small + codes[48:58].sum() + codes[128:].sum() + codes[:33].sum() + codes[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
        ends = [w[-1] for w in words]
        measures = np.array(
            [
                same.sum() / n,
                1 - plain / max(codes.sum(), 1),
                capital / max(capital + small, 1),
                sum(map("|•·".__contains__, words)) / n,
                sum(map("!?".__contains__, ends)) / n,
                len(set(words)) / np.sqrt(n),
                sum(map(".,;:".__contains__, ends)) / n,
                (capital + small + codes[128:].sum() / 2) / n,
            ]
        )
        return measures, hashed


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        self[word] = at = 1 + zlib.crc32(shape(word).encode()) % (HASHED - 1)
        return at


def votes_of(measures: np.ndarray) -> np.ndarray:
    """What the labellers say of rows of measures: first those that know bad signs, then those that know good ones."""
    columns = []
    for rules, vote in ((BAD, -1), (GOOD, 1)):
        for name, sign, limit in rules:
            values = measures[:, MEASURES.index(name)]
            columns.append(np.where(values > limit if sign == ">" else values < limit, vote, 0))
    return np.stack(columns, axis=1).astype(np.int8)


@dataclass
class QualityModel:
    label_model: LabelModel | None
    weights: np.ndarray
    intercept: float

    def score(self, text: str | Column) -> Column:
        """The chance that a text is good, 0 to 1; a null text counts as empty."""
        weights, intercept = self.weights, self.intercept

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            reader = Reader()
            for texts in batches:
                yield pa.array(sigmoid(np.array([reader.read(t.as_py() or "")[1] @ weights + intercept for t in texts], dtype=float)), pa.float64())

        return scored(text)


def held_out(doc_id: str | Column) -> Column:
    """Whether a document's label is kept from learning: a fifth of all, by the CRC of its id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", fit_docs: int = FIT_DOCS
) -> QualityModel:
    """Learn from labelled documents that are not held out, at most ``fit_docs`` of them by hash.

    Labels without a value or document are passed over; of several labels of one id the largest counts.
    Without both kinds of labels the score is the share of good ones, 1 if there are none.
    """
    known = (
        labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(quality).cast("int").alias("good"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(fit_docs)
    )

    @F.arrow_udf("struct<m:array<double>,h:array<float>>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader()
        for texts in batches:
            both = [reader.read(t.as_py() or "") for t in texts]
            lists = [pa.array([b[0] for b in both], pa.list_(pa.float64())), pa.array([b[1].astype("f4") for b in both], pa.list_(pa.float32()))]
            yield pa.StructArray.from_arrays(lists, names=["m", "h"])

    # The broadcast side has fit_docs rows of two numbers at most, and so has what comes to the driver.
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(known), "_id")
    rows = stage(found.select("_id", read("text").alias("r"), "good").select("_id", "r.*", "good"), "quality-fit").toPandas().sort_values("_id")
    given = rows.good.to_numpy(dtype=float)
    if not 0 < given.sum() < len(given):
        share = float(given.mean()) if len(given) else 1.0
        return QualityModel(None, np.zeros(2 * HASHED), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    votes, first = votes_of(np.stack(rows.m.to_numpy())), np.where(given > 0, 1 - LABEL_ERROR, LABEL_ERROR)
    model = fit_label_model(votes, first, anchored=True)
    weights, intercept = fit_logistic(np.stack(rows.h.to_numpy()), model.posterior(votes, first), ridge=3.0, steps=25)
    return QualityModel(model, weights, intercept)


def score_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", fit_docs: int = FIT_DOCS
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` (1 from 0.5) and ``kept`` for every row of ``docs``.

    Null and empty texts get the score of a text without words; a null id is not held out.  Repeated
    rows get one score each.  Columns other than id and text are not read.
    """
    model = fit_quality(docs, labels, doc_id, text, quality, fit_docs)
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), model.score("_text").alias("score"))
        .withColumns({"predicted": (F.col("score") >= 0.5).cast("int"), "kept": F.col("score") >= 0.5})
    )


@query("op7_quality")
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
