"""Byte-level BPE: texts to token ids and back.

Each match of a split pattern is encoded on its own.  Its bytes are read as Latin-1 characters so that
one Aho-Corasick automaton finds the longest token at every position.  Tokens are then laid from left
to right, longest first.  A token may follow another only if merging the two side by side gives just
these two again; where none fits, the last token gives way to its next shorter prefix.  Positions
that led nowhere are not tried again, so the work is linear in the length of the match.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from fleetstats.llm.catalog import query, table
from fleetstats.llm.names import unused

RANKS = "byte_bpe_50k.tiktoken"
# Token pairs remembered per Python worker, the last used ones.
REMEMBERED = 200_000
# Matches and their ids are remembered up to so many bytes, twice over; longer matches are not.
REMEMBERED_BYTES = 96 * 2**20
LONGEST_REMEMBERED = 256
# A remembered match takes about so many bytes more than its own.
ENTRY_BYTES = 200
# Bytes of texts that are encoded before their ids are handed on.
BATCH_BYTES = 4 * 2**20
# A rank file is read by the driver and sent to all workers, so its size is checked.
LARGEST_RANK_FILE = 64 * 2**20


def read_ranks(path: str) -> bytes:
    """A rank file: per line a token in base 64 and its rank."""
    with open(path, "rb") as file:
        data = file.read(LARGEST_RANK_FILE + 1)
    if len(data) > LARGEST_RANK_FILE:
        raise ValueError(f"{path} has more than {LARGEST_RANK_FILE} bytes")
    return data


def tokens_by_rank(rank_file: bytes) -> dict[int, bytes]:
    lines = (line.split() for line in rank_file.splitlines() if line.strip())
    return {int(rank): base64.b64decode(token) for token, rank in lines}


def decode(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    """The bytes of packed ids."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Vocabulary:
    """Tokens by rank, the automaton over them, and the memory of what was worked out before."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        import ahocorasick
        import regex

        self.tokens = tokens_by_rank(rank_file)
        self.ranks = {token: rank for rank, token in self.tokens.items()}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the rank file has no token for the bytes {missing[:5]}")
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.split = regex.compile(pattern).findall
        self.fits = functools.lru_cache(REMEMBERED)(self._fits)
        self.shorter = functools.lru_cache(REMEMBERED)(self._shorter)
        self.stands = functools.lru_cache(REMEMBERED)(self._stands)
        self.packed = _Packed(self)

    def merged(self, data: bytes) -> list[bytes]:
        """The merges done one by one; quadratic, so for the bytes of two tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when they stand side by side."""
        a, b = self.tokens[left], self.tokens[right]
        return self.merged(a + b) == [a, b]

    def _shorter(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of a token."""
        token = self.tokens[rank]
        for n in range(len(token) - 1, 0, -1):
            found = self.ranks.get(token[:n])
            if found is not None:
                return found
        return None

    def encode_match(self, match: str) -> list[int]:
        """The ids of one match of the split pattern."""
        data = match.encode("utf-8")
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = array("i", bytes(4 * n))
        for end, (length, rank) in self.automaton.iter(data.decode("latin-1")):
            longest[end - length + 1] = rank  # ends come in rising order, so the longest is last
        open_at = bytearray(b"\x01") * (n + 1)
        laid: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(self.tokens[token])
            if open_at[end] and (self.fits(laid[-1], token) if laid else self.stands(token)):
                laid.append(token)
                if end == n:
                    return laid
                at, token = end, longest[end]
                continue
            less = self.shorter(token)
            while less is None:  # no token fits here: the one before gives way
                open_at[at] = 0
                if not laid:
                    raise ValueError("the rank file cannot encode this text by merges")
                token = laid.pop()
                at -= len(self.tokens[token])
                less = self.shorter(token)
            token = less

    def _stands(self, token: int) -> bool:
        """Whether the merges of a token's own bytes give it."""
        return len(self.merged(self.tokens[token])) == 1

    def encode(self, text: str) -> bytes:
        """A whole text's ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.split(text)))


class _Packed(dict):
    """Packed ids per match, worked out when first asked for.

    When they weigh ``REMEMBERED_BYTES``, they become the older ones, which go when the next are full unless
    they are asked for again.  A long match is worked out each time.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}
        self.weight = 0

    def __missing__(self, match: str) -> bytes:
        packed = self.older.get(match)
        if packed is None:
            ids = self.vocabulary.encode_match(match)
            packed = pack(f"<{len(ids)}I", *ids)
        if len(match) > LONGEST_REMEMBERED:
            return packed
        self.weight += ENTRY_BYTES + 4 * len(match) + len(packed)
        if self.weight > REMEMBERED_BYTES:
            self.older = dict(self)
            self.clear()
            self.weight = ENTRY_BYTES + 4 * len(match) + len(packed)
        self[match] = packed
        return packed


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(rank_file: bytes, pattern: str = public_tokenizers.PATTERN) -> Vocabulary:
    """The vocabulary of a rank file, built once per Python worker."""
    key = hashlib.sha256(rank_file).hexdigest(), pattern
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(rank_file, pattern)
    return _vocabularies[key]


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of parts of a column that hold about ``most`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8")
    upto, start = sizes.cumsum(), 0
    while start < len(sizes):
        end = max(start + 1, int(upto.searchsorted(most + (upto[start - 1] if start else 0), side="right")))
        yield start, end - start
        start = end


class Codec:
    """BPE of one rank file.

    ``ranks`` is the path of the rank file on the driver; the file is bounded and sent to the workers
    once.  A match of ``pattern`` is the unit of encoding.  No special tokens.
    """

    def __init__(self, spark: SparkSession, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> None:
        self.file = spark.sparkContext.broadcast(read_ranks(ranks or public_tokenizers.path(RANKS)))
        self.pattern = pattern

    def _mapped(self, docs: DataFrame, source: str, made: dict[str, Callable[[Vocabulary], Callable]]) -> DataFrame:
        """``docs`` with ``source`` replaced by new binary columns, each worked out by a vocabulary from the one before.

        One Python worker does it all, and hands on what it has by bytes.
        """
        file, pattern = self.file, self.pattern
        kept = [c for c in docs.columns if c != source]
        fields = [docs.schema[c] for c in kept] + [StructField(n, BinaryType()) for n in made]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = vocabulary(file.value, pattern)
            steps = [step(words) for step in made.values()]
            for batch in batches:
                for start, n in _slices(batch.column(source), BATCH_BYTES):
                    part = batch.slice(start, n)
                    columns = [part.column(c) for c in kept]
                    values = part.column(source)
                    for step in steps:
                        values = pa.array((step(v.as_py()) for v in values), pa.binary())
                        columns.append(values)
                    yield pa.RecordBatch.from_arrays(columns, [*kept, *made])

        return docs.mapInArrow(run, StructType(fields))

    def encode(self, docs: DataFrame, text: str, ids: str = "ids") -> DataFrame:
        """``docs`` with the packed ids (little-endian unsigned 32-bit integers) in place of the text; none for a null or empty text."""
        return self._mapped(docs, text, {ids: lambda words: lambda t: words.encode(t or "")})

    def decode(self, docs: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
        """``docs`` with the bytes that packed ids stand for in their place; none for null.  An id not in the rank file is an error."""
        return self._mapped(docs, ids, {decoded: lambda words: lambda i: decode(i or b"", words.tokens)})

    def round_trip(self, docs: DataFrame, text: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
        """``docs`` with the ids of the text and the bytes that these decode to, in place of the text."""
        return self._mapped(
            docs, text, {ids: lambda words: lambda t: words.encode(t or ""), decoded: lambda words: lambda i: decode(i, words.tokens)}
        )


def n_tokens(ids: str | Column) -> Column:
    """How many ids are packed in a binary."""
    return (F.octet_length(ids) / 4).cast("bigint")


def ids_array(ids: str | Column) -> Column:
    """Packed ids as a list."""

    @F.arrow_udf("array<bigint>")
    def listed(packed: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(p.as_py() or b"", "<u4").astype("i8") for p in packed], pa.list_(pa.int64()))

    return listed(ids)


def encode_and_decode(docs: DataFrame, text: str = "text", ranks: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with each text's packed ``ids`` and the ``decoded`` bytes.

    A null text counts as empty; an empty text has no ids.  Repeated rows are encoded each on its
    own.  Columns not in ``keep`` are not read, so their names cannot clash.  Each text is handled on
    its own, so there is no shuffle and nothing grows but with the longest text.
    """
    (source,) = unused(keep, "_text")
    plain = docs.select(*[F.col(k) for k in keep], F.col(text).alias(source))
    return Codec(docs.sparkSession, ranks).round_trip(plain, source)


@query("op2_bpe")
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_and_decode(table(spark, folder, "documents")).select(
        "doc_id",
        n_tokens("ids").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
