import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from fleetstats.llm import near_dedup as N
from fleetstats.llm.catalog import load
from fleetstats.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def shingles(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    holders = defaultdict(set)
    for p, (_, s) in enumerate(sets):
        for x in s:
            holders[x].add(p)
    links = set()
    for ps in holders.values():
        links |= set(combinations(sorted(ps), 2))
    good = [
        (sets[p][0], sets[q][0]) for p, q in links
        if 100 * len(sets[p][1] & sets[q][1]) >= percent * len(sets[p][1] | sets[q][1])
    ]
    label = roots({i for i, _ in sets}, good)
    return sorted(
        [(i, len(shingles(t, k)), label.get(i), label.get(i) == i if i is not None else True) for i, t in rows], key=repr
    )


def answers(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def made(seed=1):
    dice, rows = random.Random(seed), []
    word = lambda: "".join(dice.choices("etaoinshrdluß", k=dice.randint(2, 7)))
    passage = [word() for _ in range(60)]
    for g in range(12):
        base = [word() for _ in range(dice.choice([3, 5, 30, 150, 400]))]
        for _ in range(dice.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(int(len(base) * dice.choice([0, 0.01, 0.02, 0.04, 0.06]))):
                copy[dice.randrange(len(copy))] = word()
            if g % 3 == 0:
                copy = passage + copy
            rows.append((len(rows) + 10, dice.choice([" ", "\n", "  "]).join(copy)))
    dice.shuffle(rows)
    long = " ".join(word() for _ in range(30000))
    return rows + [
        (1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A "), (6, "a b c"), (7, "a b c d"), (8, long), (9, long + " more"),
        (None, "a"), (None, None), (4, "a"), (11, "q w e r t y u i"), (11, "z x c v b n m k"), (900, "q w e r t y u i"), (901, "z x c v b n m k"),
    ]


@pytest.mark.parametrize("k", [4, 5])
def test_equals_brute_force(spark, k):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as node", "2 as label")
    assert answers(N.near_dedup(docs, words=k)) == brute(rows, k)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert answers(load()[0]["op9_near_dedup"](spark, FOLDER)) == brute(rows, 4)


def test_all_pairs_under_the_distance_meet(spark):
    dice = np.random.default_rng(2)
    one = dice.integers(0, 1 << N.SLOT_BITS, (200, N.SLOTS)).astype("<u2")
    two = one.copy()
    for row in two:  # as far apart as the join is certain to find
        row[dice.choice(N.SLOTS, N.CERTAIN - 1, replace=False)] ^= 1
    rows = [(i, bytes(a.tobytes()), bytes(b.tobytes())) for i, (a, b) in enumerate(zip(one, two))]
    df = spark.createDataFrame(rows, "i int, a binary, b binary").select(N.posted_keys("a").alias("a"), N.posted_keys("b").alias("b"))
    assert all(set(r.a) & set(r.b) for r in df.collect())
    assert all(len(set(r.a)) == N.SLOTS for r in df.collect())


def test_drop_keeps_one_of_each_group_and_all_columns(spark):
    rows = made(2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as kept")
    kept = N.drop_near(docs)
    assert kept.columns == docs.columns
    want = sorted(((i, t) for (i, t) in rows if i is None or dict((r[0], r[3]) for r in brute(rows, 5))[i]), key=repr)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert N.near_dedup(docs).count() == 0 and N.drop_near(docs).count() == 0


def test_components_of_chains_stars_and_no_links(spark):
    dice = random.Random(3)
    ids = list(range(300))
    dice.shuffle(ids)
    links = list(zip(ids[:99], ids[1:100])) + [(ids[100], x) for x in ids[101:200]] + [(5, 5)]
    links += [(dice.choice(ids[200:]), dice.choice(ids[200:])) for _ in range(60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = roots({x for l in links for x in l}, links)
    assert got == {n: r for n, r in want.items() if n in got}
    assert all(n in got or want[n] == n for n in want)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
