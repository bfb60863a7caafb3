import hashlib
import random
import re

import pytest

from compare import differences, duck
from fleetstats.llm import exact_dedup as X
from fleetstats.llm.catalog import load

FOLDER = "/root/testdata/sf0.001"
LONG = "Déjà vu, the quick brown fox jumps over the lazy dog. " * 700


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(rows, norm):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (3, "a  b"), (1, "a\tb"), (2, "a b "), (4, None), (5, ""), (6, " "), (7, "\n\r"), (8, LONG),
    (9, LONG.replace(" ", "\n ")), (10, LONG + "x"), (10, LONG + "x"), (11, "x" * 30000), (12, "x" * 30001), (None, "lone"),
    (None, "a b"), (13, "漢字" * 9000), (14, "漢字" * 9000), (15, "😀" * 3000), (16, "a b"),
]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("recipe", X.F.lit(1))
    got = sorted((tuple(r) for r in X.exact_dedup(docs).collect()), key=repr)
    assert got == brute(ROWS)


def test_chunks_make_up_the_text_and_follow_its_content(spark):
    dice = random.Random(1)
    varied = " ".join("".join(dice.choices("etaoinshrdluäß", k=dice.randint(2, 9))) for _ in range(4000))
    texts = [varied, "Zz " + varied, "x" * 20000, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    cut = [r[0] for r in docs.select(X.chunks(X.F.col("t"))).collect()]
    assert ["".join(c) for c in cut] == texts
    assert all(len(c) <= X.MOST for cs in cut for c in cs)
    assert len(set(cut[0]) & set(cut[1])) > 0.8 * len(cut[0])


def test_an_identifier_of_two_chunks_is_not_trusted(spark):
    rows = [(1, "s1", [(7, 1, 1)]), (2, "s2", [(7, 2, 1)]), (3, "s1", [(7, 1, 1)]), (4, "s4", [(8, 3, 3)])]
    named = spark.createDataFrame(rows, "doc_id bigint, text_sha256 string, chunks array<struct<id:bigint,hi:bigint,lo:bigint>>")
    got = {r.doc_id: tuple(r.recipe) for r in X.recipes(named).collect()}
    assert got[1] == got[3] != got[2] and got[4] == (8,)
    assert {r.id: r.verified for r in X.chunk_store(named).collect()} == {7: False, 8: True}


def test_drop_keeps_one_row_of_each_text(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("_kept", X.F.lit("mine"))
    kept = X.drop_exact(docs)
    assert kept.columns == ["doc_id", "text", "_kept"]
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert X.exact_dedup(docs).count() == 0 and X.drop_exact(docs).count() == 0


@pytest.mark.parametrize("name", ["op8_exact_dedup"])
def test_query_agrees_with_its_sql(spark, name):
    queries, oracles = load()
    assert differences(spark, duck(FOLDER), FOLDER, queries[name], oracles[name]) == []


def test_drop_with_clashing_names(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    odd = docs.withColumns({n: X.F.lit(n) for n in ("_id", "_sha", "_rows", "_kept", "_digest")})
    plain, kept = X.drop_exact(docs), X.drop_exact(odd)
    assert kept.columns == odd.columns and {r._id for r in kept.collect()} == {"_id"}
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, plain.collect()))
