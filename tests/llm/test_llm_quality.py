import random

import numpy as np
import pytest

from fleetstats.llm import quality as Q
from fleetstats.llm.catalog import load

FOLDER = "/root/testdata/sf0.01"


def test_shapes():
    assert [Q.shape(w) for w in ("Hello,", "WORD!!", "only***", "|", "a1b22", "äß")] == ["Xx,", "X!", "x*", "|", "x9x9", "x"]


def test_held_out_accuracy_on_whole_table(spark):
    got = {r.doc_id: r for r in load()[0]["op7_quality"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.kept) == int(r.score >= 0.5) for r in got.values())
    labels = [r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(labels) > 50 and np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.95


def small(spark):
    dice = random.Random(11)

    def text(bad):
        words = ["".join(dice.choices("etaoinshrdlu", k=dice.randint(2, 8))) for _ in range(60)]
        if bad == 1:
            return " ".join(w.upper() + "!!" for w in words)
        if bad == 2:
            return " ".join(w for w in words[:6] for _ in range(10))
        return " ".join(" ".join(words[i : i + 10]).capitalize() + "." for i in range(0, 60, 10))

    rows = [(i, text(i % 3), "x") for i in range(300)]
    labels = [(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None), (999, 0), (9, 0)]
    rows += [(1000, None, "x"), (1001, "", "x"), (None, text(1), "x"), (3, rows[3][1], "x"), (1002, text(0) * 300, "x"), (1003, "| " * 100000, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_scorer_learns_what_labellers_say(spark):
    docs, labels = small(spark)
    model = Q.fit_quality(docs, labels)
    accuracy = model.label_model.accuracy()
    assert accuracy[[r[0] for r in Q.BAD].index("repeated")] > 0.9
    got = Q.score_quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.kept == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 300)
    assert not [r for r in got if r.doc_id is None][0].kept and [r for r in got if r.doc_id == 1002][0].kept


@pytest.mark.parametrize("quality", [0, 1])
def test_labels_of_one_kind_and_none(spark, quality):
    docs, _ = small(spark)
    labels = spark.createDataFrame([(i, quality) for i in range(50)], "doc_id bigint, quality int")
    assert {round(r.score) for r in Q.score_quality(docs, labels).collect()} == {quality}
    assert {round(r.score) for r in Q.score_quality(docs, labels.limit(0)).collect()} == {1}
    assert Q.score_quality(docs.limit(0), labels).count() == 0


def test_held_out_labels_do_not_matter(spark):
    docs, labels = small(spark)
    turned = labels.withColumn("quality", Q.F.when(Q.held_out("doc_id"), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    one, two = (sorted((r.doc_id or -1, r.score) for r in Q.score_quality(docs, x).collect()) for x in (labels, turned))
    assert one == two
