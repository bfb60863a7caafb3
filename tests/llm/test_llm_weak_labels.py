"""The weak-supervision queries against plain versions: loops over all rows, on the driver, from the same features."""

import math
import zlib

import numpy as np

from fleetstats.llm import quality as Q
from fleetstats.llm import toxicity as T
from fleetstats.llm import weak_labels as W
from fleetstats.llm.catalog import load

FOLDER = "/root/testdata/sf0.001"


def plain_model(votes, start, anchored, rounds=W.ROUNDS):
    """Expectation-maximisation a vote at a time."""
    n, m = len(votes), len(votes[0])
    belief = [min(max(b, 0.001), 0.999) for b in start]
    first = list(belief)
    for _ in range(rounds):
        theta = [[[0.5] * 3 for _ in range(2)] for _ in range(m)]
        for row, b in zip(votes, belief):
            for v, c in enumerate(row):
                theta[v][1][c + 1] += b
                theta[v][0][c + 1] += 1 - b
        theta = [[[x / sum(cs) for x in cs] for cs in v] for v in theta]
        prior = min(max(sum(belief) / n, 1e-4), 1 - 1e-4)
        weight = []
        for v in range(m):
            total = 1.0
            for u in range(m):
                if u != v:
                    r = 0.0
                    for share in (belief, [1 - b for b in belief]):
                        s = max(sum(share), 1e-9)
                        mean = [sum(w * row[k] for w, row in zip(share, votes)) / s for k in (v, u)]
                        def cov(a, b):  # noqa: E306
                            return sum(w * (row[(v, u)[a]] - mean[a]) * (row[(v, u)[b]] - mean[b]) for w, row in zip(share, votes)) / s
                        r += cov(0, 1) / math.sqrt(max(cov(0, 0), 1e-9)) / math.sqrt(max(cov(1, 1), 1e-9)) * s
                    r /= n
                    total += r * r if abs(r) > W.CORRELATED else 0.0
            weight.append(1 / total)
        new = []
        for row, f in zip(votes, first):
            before = f if anchored else prior
            odds = math.log(before) - math.log(1 - before)
            odds += sum(weight[v] * (math.log(theta[v][1][c + 1]) - math.log(theta[v][0][c + 1])) for v, c in enumerate(row))
            new.append(1 / (1 + math.exp(-odds)))
        moved, belief = max(abs(a - b) for a, b in zip(new, belief)), new
        if moved < 1e-6:
            break
    return belief, theta, weight


def test_label_model_equals_a_plain_one():
    dice = np.random.default_rng(1)
    truth = dice.random(80) < 0.4
    votes = np.stack([np.where(dice.random(80) < 0.3, 0, np.where(dice.random(80) < a, truth, ~truth) * 2 - 1) for a in (0.9, 0.8, 0.7, 0.6)], axis=1)
    votes = np.hstack([votes, votes[:, :1]])  # a voter that repeats another
    for anchored in (True, False):
        start = np.where(truth, 0.8, 0.3)
        model = W.fit_label_model(votes, start, anchored)
        belief, theta, weight = plain_model(votes.tolist(), start.tolist(), anchored)
        assert np.allclose(model.theta, theta, atol=1e-9) and np.allclose(model.weight, weight, atol=1e-9)
        assert np.allclose(model.posterior(votes, np.clip(start, 0.001, 0.999) if anchored else None), belief, atol=1e-9)
        assert model.weight[0] < 0.7 < model.weight[1] + 0.3


def test_logistic_fit_is_where_its_slope_is_nothing():
    dice = np.random.default_rng(2)
    x, belief = dice.normal(size=(200, 3)) * [1, 5, 0.1] + [0, 3, 1], dice.random(200)
    weights, intercept = W.fit_logistic(x, belief, ridge=2.0)
    spread = x.std(axis=0)

    def loss(w, b):
        z = x @ w + b
        middle = b + x.mean(axis=0) @ w
        return (np.logaddexp(0, z) - belief * z).sum() + 1.0 * ((w * spread) ** 2).sum() + 0.5e-3 * middle**2

    for k in range(4):
        step = np.eye(4)[k] * 1e-5
        up, down = loss(weights + step[:3], intercept + step[3]), loss(weights - step[:3], intercept - step[3])
        assert abs(up - down) / 2e-5 < 1e-3


def learning(rows, field):
    """(id, text, label) of labelled documents that are not held out, by id."""
    docs, labels = rows
    known = {}
    for r in labels:
        if r.doc_id is not None and r[field] is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            known[r.doc_id] = max(known.get(r.doc_id, 0), r[field])
    return sorted((d.doc_id, d.text or "", known[d.doc_id]) for d in docs if d.doc_id in known)


def tables(spark):
    return [spark.read.parquet(f"{FOLDER}/{n}.parquet").collect() for n in ("documents", "labels")]


def test_quality_query_equals_a_plain_version(spark):
    rows = tables(spark)
    fit, reader = learning(rows, "quality"), Q.Reader()
    read = [reader.read(t) for _, t, _ in fit]
    votes = []
    for measures, _ in read:
        m = dict(zip(Q.MEASURES, measures))
        votes.append([v if (m[n] > x if s == ">" else m[n] < x) else 0 for rules, v in ((Q.BAD, -1), (Q.GOOD, 1)) for n, s, x in rules])
    first = [1 - Q.LABEL_ERROR if g else Q.LABEL_ERROR for *_, g in fit]
    belief = plain_model(votes, first, True)[0]
    # The fit reads shapes in single precision, as they are handed on.
    weights, intercept = W.fit_logistic(np.array([h.astype("f4") for _, h in read]), np.array(belief), ridge=3.0, steps=25)
    got = {r.doc_id: r.score for r in load()[0]["op7_quality"](spark, FOLDER).collect()}
    assert len(got) == len(rows[0])
    for d in rows[0]:
        z = sum(a * b for a, b in zip(reader.read(d.text or "")[1], weights)) + intercept
        assert abs(got[d.doc_id] - 1 / (1 + math.exp(-z))) < 1e-5


def test_toxicity_query_equals_a_plain_version(spark):
    rows = tables(spark)
    fit = learning(rows, "toxic")
    n, n_toxic = len(fit), sum(t for *_, t in fit)
    seen = {}
    for _, text, toxic in fit:
        for term, before in T.terms_of(text).items():
            at = seen.setdefault(term, {}).setdefault(before, [0, 0])
            at[0] += 1
            at[1] += toxic
    mined = []
    for term, befores in seen.items():
        total, t = (sum(b[i] for b in befores.values()) for i in (0, 1))
        places = sum(b[1] > 0 for b in befores.values())
        odds = math.log((min(t, places) + 0.5) / (n_toxic + 1) / ((total - t + 0.5) / (n - n_toxic + 1)))
        if places >= T.LEAST_PLACES and odds >= T.LEAST_ODDS:
            mined.append((-odds * math.sqrt(places), term, odds))
    terms = {term: odds for _, term, odds in sorted(mined)[: T.TERMS]}
    reader = T.Reader(terms)
    x = np.array([reader.features(t) for _, t, _ in fit])
    first = [1 - T.LABEL_ERROR if g else T.LABEL_ERROR for *_, g in fit]
    belief = plain_model(T.votes_of(x).tolist(), first, True)[0]
    weights, intercept = W.fit_logistic(x, np.array(belief))
    got = {r.doc_id: r.score for r in load()[0]["op5_toxicity"](spark, FOLDER).collect()}
    assert len(got) == len(rows[0])
    for d in rows[0]:
        z = np.clip(reader.features(d.text or ""), x.min(axis=0), x.max(axis=0)) @ weights + intercept
        assert abs(got[d.doc_id] - 1 / (1 + math.exp(-np.clip(z, -500, 500)))) < 1e-5
