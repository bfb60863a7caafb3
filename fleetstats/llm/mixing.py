"""Mixing a corpus to target weights by soft membership.

A classifier learnt from a labelled table gives every document its posterior over domains, so a
document counts for several domains by its shares.  Projected-gradient least squares then finds document rates, none
below a floor, whose expected tokens per domain match the targets.  Only vectors with one number per
domain ever reach the driver.  Everything here is built-in functions.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.llm.catalog import query, table
from fleetstats.llm.names import unused
from fleetstats.plans.staging import stage

# Labelled documents that the classifier is fitted on at most, taken by hash.
FIT_DOCS = 10_000
BUCKETS = 2048  # word hashes of the classifier
MOST_DOMAINS = 64
SMOOTHING = 0.5
# Words repeat each other, so a text speaks with the weight of this many at most.
EVIDENCE = 32
# Passes over the corpus at most; shares of all tokens by which a target may be missed, and below which a pass moved nothing.
STEPS, ENOUGH, SETTLED = 24, 1e-4, 1e-5
LONGEST_STEP = 20.0
MISSED = 0.01
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


@dataclass
class DomainModel:
    """Log odds of hashed words per domain (``odds[domain, bucket]``) and the domains' priors."""

    domains: list[str]
    prior: np.ndarray
    odds: np.ndarray


def words(text: str | Column) -> Column:
    """A text's lower-case words, cut at ASCII white space; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_domains(labelled: DataFrame) -> DomainModel:
    """Naive Bayes on hashed words from ``labelled`` (text, domain); rows without a domain are passed over.

    What comes to the driver is counts per (domain, bucket), of at most MOST_DOMAINS domains.
    """
    labelled = labelled.where(F.col("domain").isNotNull())
    sizes = {r.domain: r["count"] for r in labelled.groupBy("domain").count().orderBy("domain").limit(MOST_DOMAINS + 1).collect()}
    if len(sizes) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    domains = sorted(sizes)
    counts = np.zeros((len(domains), BUCKETS))
    counted = (
        labelled.select("domain", F.explode(words("text")).alias("w"))
        .groupBy("domain", _bucket(F.col("w")).alias("bucket"))
        .count()
    )
    for r in counted.collect():
        counts[domains.index(r.domain), r.bucket] = r["count"]
    smooth = counts + SMOOTHING
    share = smooth / smooth.sum(axis=1, keepdims=True)
    prior = np.array([sizes[d] for d in domains], dtype=float)
    prior /= max(prior.sum(), 1)
    # A word's odds against the domains' even mixture, so that the sizes of domains count once.
    return DomainModel(domains, prior, np.log(share) - np.log(share.mean(axis=0, keepdims=True)) if domains else counts)


def _literal(values: np.ndarray) -> Column:
    """An array of numbers as one constant."""
    return F.split(F.lit(",".join(f"{v:.5g}" for v in values)), ",").cast("array<double>")


def with_posteriors(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, their words, and ``p0``, ``p1``, ... for the model's domains.

    A text without words gets the priors.
    """
    hashes, *scores = unused(docs.columns, "_words", *[f"_s{k}" for k in range(len(model.domains))])
    hashed = docs.withColumn(hashes, F.transform(words(text), _bucket))

    def score(k: int) -> Column:
        odds = _literal(model.odds[k])
        return F.aggregate(hashes, F.lit(0.0), lambda total, bucket: total + F.get(odds, bucket))

    n = F.size(hashes)
    weight = F.least(n, F.lit(EVIDENCE)) / F.greatest(n, F.lit(1))
    scored = hashed.select(
        *docs.columns,
        n.cast("bigint").alias("n_tokens"),
        *[(score(k) * weight + F.lit(float(np.log(p)))).alias(scores[k]) for k, p in enumerate(model.prior)],
    )
    scores = [F.col(s) for s in scores]
    most = F.greatest(*scores) if len(scores) > 1 else scores[0]
    powers = [F.exp(s - most) for s in scores]
    total = sum(powers[1:], powers[0])
    return scored.select(*docs.columns, "n_tokens", *[(p / total).alias(f"p{k}") for k, p in enumerate(powers)])


def _numbers(values: np.ndarray) -> Column:
    """An array of numbers as one constant, to their last digit."""
    return F.split(F.lit(",".join(map(repr, values.ravel().tolist()))), ",").cast("array<double>")


def rate_of(taken: list[np.ndarray], domains: int, least: float) -> Column:
    """A row's rate after the steps taken: each moves it by the posteriors times one number per domain, and lifts it to ``least``.

    The steps are one constant that is folded over, so the expression has the same size for any number of them.
    """
    start = F.lit(max(1.0, least))
    if not taken:
        return start
    steps = _numbers(np.array(taken))

    def stepped(rate: Column, i: Column) -> Column:
        move = sum((F.col(f"p{k}") * F.get(steps, i * domains + k) for k in range(domains)), F.lit(0.0))
        return F.greatest(F.lit(float(least)), rate - move)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(taken) - 1)), start, stepped)


def fit_rates(members: DataFrame, domains: int, targets: np.ndarray, least: float = 0.0, steps: int = STEPS) -> tuple[Column, np.ndarray]:
    """The rate of each row of ``members`` (n_tokens, p0, p1, ...) as a column, and the tokens reached.

    Least squares of the domains' relative misses by projected gradient: a step moves a document's rate by its posteriors times
    the misses, then lifts it to ``least``.  Weighed by tokens, the curvature is at most one, so full steps converge;
    longer ones are taken as far as the curvature seen in the last allows (Barzilai-Borwein).  A rate follows from the steps
    alone: each pass reads the members, sums one number per domain and leaves no state behind.  It ends when targets are met, when a
    pass moves nothing, or after ``steps`` passes, with the best of them.
    """

    def reached(taken: list[np.ndarray]) -> np.ndarray:
        rate = rate_of(taken, domains, least)
        sums = [F.sum(rate * F.col("n_tokens") * F.col(f"p{k}")) for k in range(domains)]
        return np.array([x or 0.0 for x in members.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()])

    taken: list[np.ndarray] = []
    start = now = reached(taken)
    total, before, best = max(start.sum(), 1), None, (np.inf, 0, now)
    for _ in range(steps):
        miss = np.where(start > 0, (now - targets) / np.maximum(start, 1e-12), 0.0)
        best = min(best, (float((miss**2 * start).sum()), len(taken), now), key=lambda b: b[0])
        if (np.abs(miss) * start).max() <= ENOUGH * total or (before is not None and np.abs(now - before[1]).max() <= SETTLED * total):
            break
        length = 1.0
        if before is not None:
            bend = before[0] - miss
            length = float(np.clip((taken[-1] * start * taken[-1]).sum() / max((taken[-1] * start * bend).sum(), 1e-12), 1.0, LONGEST_STEP))
        before = (miss, now)
        taken.append(length * miss)
        now = reached(taken)
    return rate_of(taken[: best[1]], domains, least), best[2]


def labelled_sample(docs: DataFrame, labelled: DataFrame, doc_id: str, text: str, fit_docs: int) -> DataFrame:
    """``text`` and ``domain`` of the labelled documents with the smallest hashes, ``fit_docs`` at most."""
    chosen = (
        labelled.where("_id is not null and domain is not null")
        .groupBy("_id")
        .agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(fit_docs)
    )
    # The broadcast side has fit_docs rows of an id and a name at most.
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
    return stage(found.select("text", "domain"), "mixing-fit")


def wanted(natural: np.ndarray, domains: list[str], weights: Mapping[str, float] | None, temperature: float) -> np.ndarray:
    """Target tokens per domain that sum to what is there.

    ``weights`` names shares; a domain it leaves out keeps its own.  Without it, shares are the natural
    ones to the power of ``temperature``.
    """
    total = natural.sum()
    if total <= 0:
        return natural
    own = natural / total
    if weights is None:
        share = own**temperature
    else:
        share = np.array([weights.get(d, own[k]) for k, d in enumerate(domains)])
    return share / share.sum() * total


def grown(targets: np.ndarray, natural: np.ndarray, least: float) -> np.ndarray:
    """``targets`` scaled up as far as no domain has to fall below ``least`` of what it has.

    A domain with no target is passed over, as no scale reaches it.
    """
    asked = targets > 0
    return targets * max(1.0, least * (natural[asked] / targets[asked]).max(initial=0.0))


def mixture(
    docs: DataFrame,
    labelled: DataFrame,
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.5,
    least: float = 0.0,
    doc_id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
    domain: str = "domain",
    fit_docs: int = FIT_DOCS,
    grow: bool = False,
) -> tuple[DataFrame, list[str]]:
    """``doc_id``, ``n_tokens``, ``domain`` (the likeliest), ``rate`` and posteriors ``p0``, ``p1``, ... of every row
    of ``docs``, and the names of the domains.

    ``labelled`` gives the ``domain`` of some documents; nulls in it are passed over, and of several
    domains of one id the first by name counts.  A null text counts as empty: it has no tokens and the priors, and its rate is
    that of its posteriors.  With ``grow`` the tokens may become more than there are, so that the floor ``least`` keeps no
    domain above its share; shares still missed by over MISSED are warned of.  Repeated rows count each.  Without any labelled document there is one domain
    without a name, and every rate is 1 or ``least``.  Other columns are not read.  An empty table gives no rows.
    """
    names = labelled.select(F.col(label_id).alias("_id"), F.col(domain).cast("string").alias("domain"))
    model = fit_domains(labelled_sample(docs, names, doc_id, text, fit_docs))
    if not model.domains:
        model = DomainModel([""], np.ones(1), np.zeros((1, BUCKETS)))
    k = len(model.domains)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    posteriors = [f"p{i}" for i in range(k)]
    members = stage(with_posteriors(plain, model, "_text").drop("_text"), "mixing-members")
    natural = members.agg(*[F.sum(F.col("n_tokens") * F.col(p)).alias(p) for p in posteriors]).first()
    natural = np.array([x or 0.0 for x in natural])
    targets = wanted(natural, model.domains, weights, temperature)
    if grow:
        targets = grown(targets, natural, least)
    rate, now = fit_rates(members, k, targets, least)
    if grow and now.sum() > 0 and np.abs(now / now.sum() - targets / targets.sum()).max() > MISSED:
        warnings.warn(f"mixing reached {now / now.sum()} of {model.domains}, not {targets / targets.sum()}", stacklevel=2)
    best = F.greatest(*posteriors) if k > 1 else F.col("p0")
    name = F.coalesce(*[F.when(F.col(p) == best, F.lit(d)) for p, d in zip(posteriors, model.domains)])
    return members.select("doc_id", "n_tokens", name.alias("domain"), rate.alias("rate"), *posteriors), model.domains


def mix(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` as often as their rate says, with their columns.

    The whole part of a rate is copies; the rest is a chance taken by a hash of the id, so the
    same document always fares alike.  With ``least`` 1 or more, every document stays at least once.  Rows of one
    id share the mean of their rates.
    """
    rates, _ = mixture(docs, labelled, doc_id=doc_id, **options)
    theirs, rate, copies, copy = unused(docs.columns, "_id", "_rate", "_copies", "_copy")
    rates = rates.groupBy(F.col("doc_id").alias(theirs)).agg(F.avg("rate").alias(rate))
    rates = stage(rates, "mixing-rates")
    chance = F.pmod(F.xxhash64(theirs, F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    times = F.floor(F.col(rate)) + (chance < F.col(rate) - F.floor(rate)).cast("int")
    return (
        docs.join(rates, docs[doc_id].eqNullSafe(rates[theirs]))
        .withColumn(copies, times)
        .where(F.col(copies) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
        .select(*[docs[c] for c in docs.columns])
    )


# Target shares of tokens by language.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def labelled_languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The labelled documents with their language as domain; the broadcast decision is left to their size."""
    labels = table(spark, folder, "labels").select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels, "doc_id", "left_semi")


@query("op1_mixing")
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    mixed, domains = mixture(docs, labelled_languages(spark, docs, folder), TARGETS)
    names = [F.col(f"p{k}").alias(f"p_{d or 'none'}") for k, d in enumerate(domains)]
    return mixed.select("doc_id", "n_tokens", "domain", "rate", *names)
