import numpy as np
import pytest

from fleetstats.llm import neighbours as N
from fleetstats.llm.catalog import load


def brute(ids, v, asked, k):
    out = {}
    for q in asked:
        score = (v * v[ids.index(q)]).sum(axis=1)
        order = sorted((-s, i) for s, i in zip(score, ids) if i != q)[:k]
        out[q] = [(i, -s) for s, i in order]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for rows in out.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return out


def recall(got, want):
    right = sum(len({i for _, i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    return right / sum(len(w) for w in want.values())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float)
    want = brute(ids, v, [i for i in ids if i % 20 == 0], 20)
    got = found(load()[0]["op6_neighbours"](spark, folder))
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert recall(got, want) >= 0.95
    by_id = dict(zip(ids, v))
    for q, rows in list(got.items())[:20]:
        assert all(abs(s - by_id[q] @ by_id[i]) < 1e-12 for _, i, s in rows)


def test_lengths_matter_for_the_product(spark):
    dice = np.random.default_rng(5)
    v = dice.normal(size=(3000, 16)) * dice.lognormal(0, 0.7, (3000, 1))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id bigint, embedding array<double>")
    want = brute(list(range(3000)), v, list(range(0, 3000, 20)), 20)
    assert recall(found(N.search(df, N.F.col("vec_id") % 20 == 0)), want) >= 0.9


def test_copies_ties_few_rows_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0], 0) for i in range(40, 400)] + [
        (0, [1.0, 2.0], 0), (20, [2.0, 1.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0),
        (5, [None, 1.0], 0), (None, [9.0, 9.0], 0), (6, [1.0, 2.0, 3.0], 0), (20, [2.0, 1.0], 0), (7, [], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int")
    got = found(N.search(df, N.F.col("vec_id") % 20 == 0))
    assert [i for _, i, _ in got[0]] == list(range(40, 60))
    assert [i for _, i, _ in got[60]] == [0] + list(range(40, 59))
    assert [i for _, i, _ in got[20]] == [0] + list(range(40, 59)) and {s for _, _, s in got[20]} == {4.0}
    few = found(N.search(df.where("vec_id in (0, 20)"), N.F.col("vec_id") % 20 == 0))
    assert few == {0: [(1, 20, 4.0)], 20: [(1, 0, 4.0)]}
    assert N.search(df.limit(0), N.F.col("vec_id") % 20 == 0).count() == 0
    assert N.search(df, N.F.lit(False)).count() == 0


def test_clustered_vectors_need_few_files(spark):
    dice = np.random.default_rng(8)
    centres = dice.normal(size=(40, 24))
    v = centres[dice.integers(0, 40, 6000)] + 0.15 * dice.normal(size=(6000, 24))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id bigint, embedding array<double>")
    fitted, real = [], N._fit
    N._fit = lambda *a: fitted.append(real(*a)) or fitted[-1]
    try:
        got = found(N.search(df, N.F.col("vec_id") % 20 == 0))
    finally:
        N._fit = real
    assert recall(got, brute(list(range(6000)), v, list(range(0, 6000, 20)), 20)) >= 0.93
    assert fitted[0][0] <= N.PIVOTS // 4


def test_large_files_and_many_queries_are_split(spark, monkeypatch):
    """Smaller files and groups of queries give the same neighbours; the index does not grow with the queries but by groups."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    whole = found(N.search(rows, N.F.col("vec_id") % 20 == 0, recall=1.0, pivots=8))
    monkeypatch.setattr(N, "VECTORS", 100)
    monkeypatch.setattr(N, "QUERIES", 30)
    assert found(N.search(rows, N.F.col("vec_id") % 20 == 0, recall=1.0, pivots=8)).keys() == whole.keys()
    ids = [r.vec_id for r in rows.select("vec_id").collect()]
    v = np.array([r.embedding for r in rows.collect()], float)
    got = found(N.search(rows, N.F.col("vec_id") % 20 == 0, recall=1.0, pivots=8))
    assert recall(got, brute(ids, v, [i for i in ids if i % 20 == 0], 20)) >= 0.97
