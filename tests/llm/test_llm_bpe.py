import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetstats.llm import bpe
from fleetstats.llm.catalog import load

PATH = P.path("byte_bpe_50k.tiktoken")
FOLDER = "/root/testdata/sf0.001"


def library(path):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    path = P.path(request.param)
    return library(path), bpe.Vocabulary(bpe.read_ranks(path), P.PATTERN)


def ids(v, text):
    return [i for (i,) in struct.iter_unpack("<I", v.encode(text))]


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200))
def test_any_text_as_the_library_does(both, text):
    reference, v = both
    assert ids(v, text) == reference.encode_ordinary(text)
    assert bpe.decode(v.encode(text), v.tokens) == text.encode()


@settings(max_examples=300, deadline=None)
@given(text=st.text("abcdeorstinh ", min_size=1, max_size=300))
def test_letters_as_the_library_does(both, text):
    reference, v = both
    assert ids(v, text) == reference.encode_ordinary(text)
    assert ids(v, text.replace(" ", "")) == reference.encode_ordinary(text.replace(" ", ""))


def test_long_matches_and_every_token(both):
    reference, v = both
    dice = random.Random(7)
    long = ["a" * 20000, "ab" * 9000, "".join(dice.choices("etaoinshrdlu", k=20000)), "=" * 5000, " " * 5000, "漢" * 4000, "🙂" * 3000]
    for text in long:
        assert ids(v, text) == reference.encode_ordinary(text)
    for rank, token in list(v.tokens.items())[::7]:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        assert ids(v, text) == reference.encode_ordinary(text)


def test_query_matches_the_library(spark):
    reference = library(PATH)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in load()[0]["op2_bpe"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want = reference.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_nulls_repeats_clashing_names_and_no_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "hello  world\n", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id or 0, bytes(r.decoded)) for r in bpe.encode_and_decode(docs).collect())
    assert got == [(0, b""), (1, b""), (1, b""), (2, b"hello  world\n")]
    listed = bpe.encode_and_decode(docs.where("doc_id = 2")).select(bpe.ids_array("ids").alias("i")).first().i
    assert listed == library(PATH).encode_ordinary("hello  world\n")
    assert bpe.encode_and_decode(docs.limit(0)).count() == 0


def test_a_rank_file_without_a_byte_is_refused(tmp_path):
    path = tmp_path / "r"
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + f" {b}\n".encode() for b in range(255)))
    with pytest.raises(ValueError):
        bpe.Vocabulary(bpe.read_ranks(str(path)), P.PATTERN)


def test_memory_of_matches_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 2**20)
    v = bpe.Vocabulary(bpe.read_ranks(PATH), P.PATTERN)
    dice = random.Random(3)
    for _ in range(600):
        v.encode(" ".join("".join(dice.choices("etaoinshrdlu", k=dice.randint(3, 12))) for _ in range(30)))
        assert v.packed.weight <= bpe.REMEMBERED_BYTES
    assert v.packed.older
    before = len(v.packed)
    v.encode("x" * (bpe.LONGEST_REMEMBERED + 1))
    assert len(v.packed) == before


def test_one_huge_match_and_many_long_documents_come_back(spark):
    """What is held at once is one text, or some megabytes of them."""
    reference = library(PATH)
    huge = "ab" * 2_000_000
    long = "the quick brown fox, naïve and 漢字 " * 3000
    rows = [(0, huge)] + [(i, f"{i} {long}") for i in range(1, 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    got = bpe.encode_and_decode(docs).select(
        "doc_id", bpe.n_tokens("ids").alias("n"), bpe.F.sha2("ids", 256).alias("ids"), bpe.F.sha2("decoded", 256).alias("decoded")
    )
    got = {r.doc_id: r for r in got.collect()}
    assert all(got[i].decoded == hashlib.sha256(t.encode()).hexdigest() for i, t in rows)
    want = reference.encode_ordinary(rows[7][1])
    assert (got[7].n, got[7].ids) == (len(want), hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest())


def test_texts_are_cut_by_bytes():
    import pyarrow as pa

    texts = pa.array(["aaaa", None, "", "bbbbbbbbbbbb", "cc", "dd", "ee"])
    assert list(bpe._slices(texts, 6)) == [(0, 3), (3, 1), (4, 3)]
    assert list(bpe._slices(texts.slice(4), 1)) == [(0, 1), (1, 1), (2, 1)] and list(bpe._slices(texts.slice(7), 5)) == []


def test_ids_alone_decode(spark):
    codec = bpe.Codec(spark)
    docs = spark.createDataFrame([(1, "hello  world\n"), (2, None)], "doc_id bigint, text string")
    back = codec.decode(codec.encode(docs, "text"))
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {1: b"hello  world\n", 2: b""}
