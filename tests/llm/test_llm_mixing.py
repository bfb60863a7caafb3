import random

import numpy as np
import pytest

from fleetstats.llm import mixing as M
from fleetstats.llm.catalog import load

FOLDER = "/root/testdata/sf0.01"
VOCABULARY = {"aa": "etaoin", "bb": "shrdlu", "cc": "cmfwyp"}


def made(spark, n=300):
    dice, rows, labels = random.Random(8), [], []
    for i in range(n):
        names = dice.choices(list(VOCABULARY), [6, 3, 1], k=1)
        if i % 7 == 0:
            names.append(dice.choice(list(VOCABULARY)))  # a document of two domains
        text = " ".join("".join(dice.choices(VOCABULARY[dice.choice(names)], k=3)) for _ in range(dice.randint(1, 120)))
        rows.append((i, text, "x"))
        if i % 3 == 0:
            labels.append((i, names[0]))
    rows += [(1000, None, "y"), (1001, "", "y"), (None, "eta oin", "y"), (5, rows[5][1], "y"), (1002, "shr dlu " * 40000, "y")]
    labels += [(None, "aa"), (9, None), (7777, "bb"), (3, "bb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rate string")
    return docs, spark.createDataFrame(labels, "doc_id bigint, domain string")


def brute_rates(p, tokens, targets, least):
    """The same least squares by a general bounded solver over the members, many small steps."""
    start = (tokens[:, None] * p).sum(axis=0) * max(1, least)
    r = np.full(len(p), max(1.0, least))
    for _ in range(20000):
        miss = ((r * tokens) @ p - targets) / start
        r = np.maximum(least, r - 0.5 * p @ miss)
    return r


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_rates_solve_the_least_squares(spark, least):
    docs, labels = made(spark)
    weights = {"aa": 0.2, "bb": 0.3, "cc": 0.5}
    mixed, domains = M.mixture(docs, labels, weights, least=least)
    rows = mixed.collect()
    assert domains == ["aa", "bb", "cc"] and len(rows) == docs.count()
    p = np.array([[r.p0, r.p1, r.p2] for r in rows])
    tokens = np.array([r.n_tokens for r in rows], float)
    rate = np.array([r.rate for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (rate >= least).all()
    targets = np.array([weights[d] for d in domains]) * tokens.sum()
    want = brute_rates(p, tokens, targets, least)
    miss = lambda r: (((r * tokens) @ p - targets) ** 2 / (tokens @ p)).sum()
    assert miss(rate) <= miss(want) * 1.001 + 1e-3 * tokens.sum() * 1e-4
    if least == 0:
        assert np.allclose((rate * tokens) @ p, targets, rtol=1e-3)


def test_posteriors_are_those_of_naive_bayes(spark):
    docs, labels = made(spark)
    model = M.fit_domains(M.labelled_sample(docs, labels.withColumnRenamed("doc_id", "_id"), "doc_id", "text", 10**6))
    buckets = {}
    got = M.with_posteriors(docs.where("doc_id < 40"), model).withColumn("w", M.F.transform(M.words("text"), M._bucket)).collect()
    for r in got:
        s = np.log(model.prior) + model.odds[:, r.w].sum(axis=1) * min(len(r.w), M.EVIDENCE) / max(len(r.w), 1)
        p = np.exp(s - s.max())
        assert r.n_tokens == len((r.text or "").split()) == len(r.w)
        assert np.allclose([r.p0, r.p1, r.p2], p / p.sum(), atol=1e-3)


def test_mix_keeps_every_document_when_told_and_reaches_the_targets(spark):
    docs, labels = made(spark)
    docs = docs.where("doc_id < 1000 or doc_id is null or text is null")
    out = M.mix(docs, labels, least=1.0, temperature=0.3)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert out.count() > docs.count()
    less = M.mix(docs, labels, weights={"aa": 0.0, "bb": 1.0, "cc": 0.0})
    assert 0 < less.select("doc_id").distinct().count() < docs.count()


def test_no_labels_one_domain_and_no_rows(spark):
    docs, labels = made(spark, 20)
    for some in (labels.limit(0), labels.withColumn("domain", M.F.lit("only"))):
        mixed, domains = M.mixture(docs, some)
        assert len(domains) == 1 and {round(r.rate, 6) for r in mixed.collect()} == {1.0}
    assert M.mixture(docs.limit(0), labels)[0].count() == 0 and M.mix(docs.limit(0), labels).count() == 0


def test_query_names_languages_and_meets_the_targets(spark):
    got = load()[0]["op1_mixing"](spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and (both.domain == both.lang).mean() > 0.95
    reached = {d: (got.rate * got.n_tokens * got[f"p_{d}"]).sum() / got.n_tokens.sum() for d in M.TARGETS}
    assert all(abs(reached[d] - w) < 0.01 for d, w in M.TARGETS.items())


def test_pipeline_stage_reaches_the_targets_with_one_dominant_language(spark, tmp_path):
    import corpus_pipeline

    dice, own = random.Random(3), {"en": "etaoin", "de": "shrdlu", "es": "cmfwyp", "fr": "vbgkqj"}
    langs = dice.choices(list(own), [70, 20, 7, 3], k=3000)
    rows = [(i, " ".join("".join(dice.choices(own[d], k=3)) for _ in range(40)), d) for i, d in enumerate(langs)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    docs.selectExpr("doc_id").where("doc_id % 2 = 0").write.parquet(f"{tmp_path}/labels.parquet")
    got = [r.lang for r in corpus_pipeline.mixed(spark, docs, str(tmp_path)).select("lang").collect()]
    power = {d: langs.count(d) ** corpus_pipeline.TEMPERATURE for d in own}
    missed = {d: got.count(d) / len(got) - power[d] / sum(power.values()) for d in own}
    assert all(abs(x) < 0.01 for x in missed.values()), missed
    assert all(got.count(d) >= langs.count(d) for d in own)


def test_passes_are_few_and_their_expressions_do_not_grow(spark):
    docs, labels = made(spark)
    sizes = []
    rows = M.mixture(docs, labels, {"aa": 0.2, "bb": 0.3, "cc": 0.5})[0].select("n_tokens", "p0", "p1", "p2")
    members = M.stage(rows, "members")
    agg = type(members).agg

    def counted(self, *columns):
        out = agg(self, *columns)
        sizes.append(out._jdf.queryExecution().optimizedPlan().toString().count("greatest"))
        return out

    type(members).agg = counted
    try:
        natural = np.array([6.0, 3.0, 1.0])
        M.fit_rates(members, 3, 5000 * natural[::-1], steps=5)
        M.fit_rates(members, 3, 5000 * natural[::-1], steps=60)
        many = len(sizes)
        M.fit_rates(members, 3, 5000 * natural[::-1], least=1.0)
    finally:
        type(members).agg = agg
    # The steps are a constant of the plan; its expressions stay as they are from the second pass on.
    assert len(sizes) > 8 and max(sizes) == sizes[1]
    assert len(sizes) - many <= M.STEPS + 1


def test_mix_with_clashing_names(spark):
    docs, labels = made(spark, 30)
    odd = docs.select("doc_id", "text").withColumns({"_id": M.F.lit(1), "_rate": M.F.lit("r"), "_copies": M.F.lit(None), "_copy": M.F.lit(0), "_words": M.F.lit(2)})
    out = M.mix(odd, labels, least=1.0)
    assert out.columns == odd.columns and {r._id for r in out.collect()} == {1}
