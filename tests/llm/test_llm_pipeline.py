import base64
import hashlib
import random
import struct
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as entry_points
import corpus_pipeline
from fleetstats.llm import mixing
from test_llm_near_dedup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ALPHABETS = {"en": "etaoin", "de": "shrdlu"}


def words(dice, lang, n):
    return ["".join(dice.choices(ALPHABETS[lang], k=dice.randint(3, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents of two languages, with toxic ones, exact and near copies, nulls and repeated rows."""
    dice, rows, labels = random.Random(12), [], []
    for i in range(500):
        lang = "de" if i % 5 == 0 else "en"
        text = words(dice, lang, 100)
        if i % 10 == 3:
            for _ in range(5):
                text.insert(dice.randrange(100), "idiot")
        rows.append((i, " ".join(text), lang, "s", 0))
        if i % 2:
            labels.append((i, 1, int(i % 10 == 3)))
    clean = [r for r in rows if r[0] % 10 != 3]
    for n, r in enumerate(clean[:40]):
        rows.append((600 + n, r[1].replace(" ", "  "), r[2], "copy", 0))
    for n, r in enumerate(clean[40:80]):
        text = r[1].split(" ")
        text[50] = "changed"
        rows.append((700 + n, " ".join(text), r[2], "near", 0))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), rows[7], rows[7], (902, " ".join(words(dice, "en", 20000)), "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    assert "pipeline" in entry_points.queries() and corpus_pipeline.ORACLE_SQL is None


def test_each_stage_against_a_plain_version(spark, folder):
    path, rows = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), [(r[0], r[1]) for r in rows]
    steps = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = steps[name](spark, docs, path)
        assert out.columns == COLUMNS
        out = mixing.stage(out, f"test-{name}")
        return out, sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)

    docs, got = step("toxicity", docs)
    kept = [(i, t) for i, t in kept if not (i < 500 and i % 10 == 3)]
    assert {i for i, _ in got} ^ {i for i, _ in kept} == set()
    assert got == sorted(kept, key=repr)

    docs, got = step("exact_dedup", docs)
    smallest = {}
    for i, t in kept:
        key = " ".join((t or "").split())
        smallest[key] = min(smallest.get(key, i), i)
    kept = sorted({(i, t) for i, t in kept if smallest[" ".join((t or "").split())] == i}, key=repr)
    assert got == kept

    docs, got = step("near_dedup", docs)
    stays = {r[0] for r in brute(kept, 5) if r[3]}
    kept = [(i, t) for i, t in kept if i in stays]
    assert got == kept and not any(700 <= i < 800 for i, _ in got)

    docs, got = step("mixing", docs)
    copies = Counter(i for i, _ in got)
    assert set(got) == set(kept)
    tokens = Counter()
    for i, t in got:
        tokens["de" if i % 5 == 0 and i < 500 else "en"] += len((t or "").split())
    natural = Counter()
    for i, t in kept:
        natural["de" if i % 5 == 0 and i < 500 else "en"] += len((t or "").split())
    power = {k: (v / sum(natural.values())) ** corpus_pipeline.TEMPERATURE for k, v in natural.items()}
    assert abs(tokens["de"] / sum(tokens.values()) - power["de"] / sum(power.values())) < 0.05
    assert max(copies.values()) > 1

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = steps["bpe"](spark, docs, path).collect()
    texts = dict(kept)
    assert Counter(r.doc_id for r in final) == copies
    for r in final:
        ids = reference.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_run_is_all_stages(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    ids = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert not any(600 <= i < 800 or (i < 500 and i % 10 == 3) for i in ids) and {900, 902} <= set(ids)
