"""Toxicity by weak supervision.

Lexicons are mined from labelled documents of the learning part: words, and beginnings of words, that
toxic documents use far more often.  Each lexicon, each level of density and each pattern is a voter.
A generative label model, anchored in the given labels, estimates their accuracies and correlations;
its posterior labels train the linear classifier that scores every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.llm.batches import Batches, arrow_schema
from fleetstats.llm.catalog import query, table
from fleetstats.llm.weak_labels import LabelModel, fit_label_model, fit_logistic, sigmoid
from fleetstats.plans.staging import stage

# Labelled documents that the classifier is fitted on at most, taken by hash.
FIT_DOCS = 12_000
# Mined terms: how many at most, after how many different words at least, and by what log odds.
TERMS, LEAST_PLACES, LEAST_ODDS = 2000, 5, 3.0
LEXICONS = 16  # the terms are dealt by hash into so many
TERM_ROWS = 20_000  # of a batch of terms that a task hands on
PREFIXES = (4, 5, 6)  # a mined beginning of a word ends in PREFIX_MARK
PREFIX_MARK = "*"
LABEL_ERROR = 0.05  # how often a given label may be wrong; the voters are weighed against it
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 200_000  # words whose lexicon a Python worker remembers
# Common English insults, a lexicon that needs no labels.
SEED = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash garbage disgusting clown clowns fool "
    "fools imbecile cretin filth vermin freak freaks bastard bastards jerk ugly hate hated shut".split()
)
DENSITIES = (0.002, 0.005, 0.01)  # of mined words among all
# Features, all by length, so that a long text's strays do not add up: density of each lexicon, of mined words
# by the strength of their terms, of mined and of seed words; shouting, exclamations, repeats.
N_FEATURES = LEXICONS + 6
N_VOTERS = LEXICONS + 1 + len(DENSITIES) + 4
DAMPED = 50  # words added to a text's length, so that one hit in a few words is no certainty


def terms_of(text: str) -> dict[str, str]:
    """A text's words and beginnings of words, each with the word before its first place."""
    words = WORD.findall(text.lower())
    terms: dict[str, str] = {}
    for before, word in zip(["", *words], words):
        if word not in terms:
            terms[word] = before
            for n in PREFIXES:
                if len(word) > n:
                    terms.setdefault(word[:n] + PREFIX_MARK, before)
    return terms


class Reader:
    """Features of texts for given mined terms and their log odds."""

    def __init__(self, terms: dict[str, float]) -> None:
        self.known = _Known(terms)

    def features(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        if len(self.known) > REMEMBERED:
            self.known.clear()
        # Most words are of no lexicon; what is left is few.
        hits = list(filter(None, map(self.known.__getitem__, words)))
        n = len(words)
        lexicons = np.bincount([h[0] for h in hits if h[0] >= 0], minlength=LEXICONS) if hits else np.zeros(LEXICONS)
        strength, seeds = sum(h[1] for h in hits), sum(h[2] for h in hits)
        codes = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128)
        capital, small = codes[65:91].sum(), codes[97:123].sum()
        length = n + DAMPED
        return np.concatenate(
            [
                lexicons / length,
                [
                    np.log(strength / length + 1e-3), np.log(lexicons.sum() / length + 1e-3), seeds / length,
                    capital / max(capital + small, 1), min(codes[33] / max(n, 1), 1.0), 1 - len(set(words)) / max(n, 1),
                ],
            ]
        )


class _Known(dict):
    """Of a word its lexicon (-1 for a seed that is not mined), strength and whether it is a seed; None for most."""

    def __init__(self, terms: dict[str, float]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> tuple[int, float, bool] | None:
        # The shortest beginning comes first, so that words unseen in the fit fall where their like do.
        found = [t for t in (*(word[:n] + PREFIX_MARK for n in PREFIXES if len(word) > n), word) if t in self.terms]
        if found:
            place = zlib.crc32(found[0].encode()) % LEXICONS, max(self.terms[t] for t in found), word in SEED
        else:
            place = (-1, 0.0, True) if word in SEED else None
        self[word] = place
        return place


def votes_of(x: np.ndarray) -> np.ndarray:
    """What the voters say of rows of features."""
    votes = np.zeros((len(x), N_VOTERS), dtype=np.int8)
    density = np.exp(x[:, LEXICONS + 1]) - 1e-3
    seeds, upper, marks, repeats = (x[:, LEXICONS + i] for i in (2, 3, 4, 5))
    votes[:, :LEXICONS] = x[:, :LEXICONS] > 0
    votes[:, LEXICONS] = seeds > 0
    at = LEXICONS + 1
    for level in DENSITIES:
        votes[:, at] = np.where(density >= level, 1, -1)
        at += 1
    votes[:, at] = np.where((density < 1e-6) & (seeds == 0), -1, 0)
    votes[:, at + 1] = upper > 0.5
    votes[:, at + 2] = marks > 0.2
    votes[:, at + 3] = np.where(repeats > 0.8, 1, 0)
    return votes


@dataclass
class ToxicityModel:
    """``label_model`` is of the voters of ``votes_of``, around the given labels.

    Features are held to ``low`` and ``high``, the range that the fit has seen, so that a text unlike any
    of its is not judged by a straight line carried on.
    """

    terms: dict[str, float]
    label_model: LabelModel | None
    weights: np.ndarray
    intercept: float
    low: np.ndarray
    high: np.ndarray

    def score(self, text: str | Column) -> Column:
        """The chance that a text is toxic, 0 to 1; a null text counts as empty."""
        terms, weights, intercept, low, high = self.terms, self.weights, self.intercept, self.low, self.high

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            reader = Reader(terms)
            for texts in batches:
                x = [np.clip(reader.features(t.as_py() or ""), low, high) @ weights + intercept for t in texts]
                yield pa.array(sigmoid(np.array(x, dtype=float)), pa.float64())

        return scored(text)


def features(text: str | Column, terms: dict[str, float]) -> Column:
    @F.arrow_udf("array<double>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(terms)
        for texts in batches:
            yield pa.array([reader.features(t.as_py() or "") for t in texts], pa.list_(pa.float64()))

    return read(text)


def held_out(doc_id: str | Column) -> Column:
    """Whether a document's label is kept from learning: a fifth of all, by the CRC of its id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def mine_terms(labelled: DataFrame) -> dict[str, float]:
    """Terms of ``labelled`` (text, toxic) that toxic documents hold far more often, with their log odds.

    A term counts by the different words that it follows in toxic documents: words that copies of one toxic
    document share always follow the same, while what makes documents toxic turns up anywhere.
    Counts combine before the shuffle.  At most ``TERMS`` terms come to the driver.
    """

    found = arrow_schema("toxic int, term string, before string")

    def distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(found, TERM_ROWS)
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text")):
                for term, before in terms_of(text.as_py() or "").items():
                    yield from out.add((toxic, term, before))
        yield from out.flush()

    n, n_toxic = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        return {}
    in_toxic = (F.least("t", "places") + 0.5) / (n_toxic + 1)
    in_clean = (F.col("n") - F.col("t") + 0.5) / (n - n_toxic + 1)
    counted = (
        labelled.select("toxic", "text")
        .mapInArrow(distinct_terms, "toxic int, term string, before string")
        .groupBy("term", F.xxhash64("before").alias("before"))
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.count_if(F.col("t") > 0).alias("places"))
        .where(F.col("places") >= LEAST_PLACES)
        .withColumn("odds", F.log(in_toxic / in_clean))
        .where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc(F.col("odds") * F.sqrt("places")), "term")
        .limit(TERMS)
    )
    return {r.term: r.odds for r in counted.select("term", "odds").collect()}


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", fit_docs: int = FIT_DOCS
) -> ToxicityModel:
    """Learn from labelled documents that are not held out, at most ``fit_docs`` of them by hash.

    Labels without a value or document are passed over; of several labels of one id the largest
    counts.  Without both kinds of labels the score is the share of toxic ones, 0 if there are none.
    """
    known = (
        labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(toxic).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(fit_docs)
    )
    # The broadcast side has fit_docs rows of two numbers at most.
    labelled = stage(
        docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .join(F.broadcast(known), "_id")
        .select("_id", "text", "toxic"),
        "toxicity-fit",
    )
    terms = mine_terms(labelled)
    rows = labelled.select("_id", features("text", terms).alias("x"), "toxic").toPandas().sort_values("_id")
    given = rows.toxic.to_numpy(dtype=float)
    if not 0 < given.sum() < len(given):
        share = float(given.mean()) if len(given) else 0.0
        flat = np.zeros(N_FEATURES)
        return ToxicityModel(terms, None, flat, float(np.log((share + 1e-9) / (1 - share + 1e-9))), flat, flat)
    x = np.stack(rows.x.to_numpy())
    votes, first = votes_of(x), np.where(given > 0, 1 - LABEL_ERROR, LABEL_ERROR)
    model = fit_label_model(votes, first, anchored=True)
    weights, intercept = fit_logistic(x, model.posterior(votes, first))
    return ToxicityModel(terms, model, weights, intercept, x.min(axis=0), x.max(axis=0))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", fit_docs: int = FIT_DOCS
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from 0.5) for every row of ``docs``.

    Null and empty texts get the score of a text without words; a null id is not held out.  Repeated
    rows get one score each.  Columns other than id and text are not read.
    """
    model = fit_toxicity(docs, labels, doc_id, text, toxic, fit_docs)
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), model.score("_text").alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    model = fit_toxicity(docs, labels, doc_id, text)
    return docs.where(model.score(F.coalesce(F.col(text), F.lit(""))) < 0.5)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
