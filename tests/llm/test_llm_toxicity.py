import random
import zlib

import numpy as np
import pytest

from fleetstats.llm import toxicity as T
from fleetstats.llm import weak_labels as W
from fleetstats.llm.catalog import load

FOLDER = "/root/testdata/sf0.01"


def test_label_model_finds_accuracies_and_correlations():
    dice = np.random.default_rng(3)
    y = dice.random(6000) < 0.3
    accuracies = [0.95, 0.85, 0.7, 0.6]
    said = [np.where(dice.random(6000) < a, y, ~y) for a in accuracies]
    said.append(said[2])  # one voter repeats another
    votes = np.where(np.stack(said, axis=1), 1, -1)
    votes[dice.random(votes.shape) < 0.1] = 0
    model = W.fit_label_model(votes, np.where(votes.sum(axis=1) > 0, 0.8, 0.2))
    assert np.allclose(model.accuracy()[:4], accuracies, atol=0.05)
    assert model.correlation[2, 4] > 0.5 and model.weight[4] < 0.85 < model.weight[0]
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.93


def test_logistic_recovers_a_soft_rule():
    dice = np.random.default_rng(4)
    x = dice.normal(size=(4000, 3)) * [1, 10, 0.1] + 5
    p = W.sigmoid(x @ [1.5, -0.1, 0] - 2)
    w, b = W.fit_logistic(x, p, ridge=0.01)
    assert np.abs(W.sigmoid(x @ w + b) - p).max() < 0.02


def test_held_out_accuracy_on_whole_table(spark):
    got = {r.doc_id: r for r in load()[0]["op5_toxicity"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    labels = [r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = np.mean([got[r.doc_id].predicted == r.toxic for r in labels])
    assert len(labels) > 50 and right > 0.95


def words(dice, n):
    return " ".join("".join(dice.choices("etaoinshrdlu", k=dice.randint(2, 8))) for _ in range(n))


def small(spark):
    dice, rows, labels = random.Random(5), [], []
    for i in range(400):
        bad, text = i % 4 == 0, words(dice, 80).split()
        for _ in range(3 * bad):
            text.insert(dice.randrange(80), "gromp" + dice.choice(["el", "ash", "intu", "or"]))
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(bad)))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "grompel grompash", "x"), (3, rows[3][1], "x"), (1002, words(dice, 60000), "x")]
    labels += [(None, 1), (7, None), (5000, 1), (4, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_mined_beginnings_catch_words_not_seen(spark):
    docs, labels = small(spark)
    model = T.fit_toxicity(docs, labels)
    assert "grom*" in model.terms
    got = {(r.doc_id, r.score): r for r in T.score_toxicity(docs, labels).collect()}
    for (i, _), r in got.items():
        assert r.predicted == int(i is None or (i < 1000 and i % 4 == 0)), r
    assert len(T.score_toxicity(docs, labels).collect()) == docs.count()
    unseen = spark.createDataFrame([(1, words(random.Random(6), 50) + " grompuzzle grompled grompano")], "doc_id bigint, text string")
    assert unseen.select(model.score("text")).first()[0] > 0.5
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 1000 or doc_id = 1001").count() == 2


@pytest.mark.parametrize("toxic", [0, 1])
def test_labels_of_one_kind_and_none(spark, toxic):
    docs, _ = small(spark)
    labels = spark.createDataFrame([(i, toxic) for i in range(50)], "doc_id bigint, toxic int")
    assert {round(r.score) for r in T.score_toxicity(docs, labels).collect()} == {toxic}
    assert {round(r.score) for r in T.score_toxicity(docs, labels.limit(0)).collect()} == {0}
    assert T.score_toxicity(docs.limit(0), labels).count() == 0


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels = small(spark)
    turned = labels.withColumn("toxic", T.F.when(T.held_out("doc_id"), 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    one, two = (sorted((r.doc_id or -1, r.score) for r in T.score_toxicity(docs, x).collect()) for x in (labels, turned))
    assert one == two
