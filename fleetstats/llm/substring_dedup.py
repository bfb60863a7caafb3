"""Substring dedup by content-defined chunking.

A gear rolling hash over the bytes cuts a text where its last WINDOW bytes say so, so that an insertion
moves cuts only near itself.  Chunks are deduplicated by digest: the document with the smallest id keeps a
chunk, and runs of chunks that an earlier document keeps are repeated passages.

Chunks find their common cuts a few chunks into a passage, so a passage of short or alike words may leave a short
run or none.  Grams of GRAM words, chosen by the least hash in every PASSAGE_WORDS words, stand beside the chunks: two
documents with so many words in common have one of them in common, whatever the words.  Around those that no
run tells of, all grams are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetstats.llm.catalog import query, table
from fleetstats.llm.names import unused
from fleetstats.plans.staging import stage, unstage

WINDOW = 16  # bytes that decide a cut; the hash has as many bits
LEAST, MOST = 16, 128  # bytes of a chunk; the last of a text may be shorter
CUT_BITS = 4  # one place in 16 is a cut, so chunks have 32 bytes on average
# Words of a run of repeated chunks that make a repeated passage.  A passage loses some chunks at each end, often 13
# words, more where words are short; lines that many documents share leave less.
RUN_WORDS = 20
# A document is named as a passage's first only for so many of its words, or for the most of them.
SOURCE_WORDS = 15
GRAM, PASSAGE_WORDS = 8, 51  # words of a gram; passages of so many are found even if no run of chunks tells of them
NEAR = PASSAGE_WORDS - GRAM  # a passage that holds a gram has others at most so far from it, if it is no longer
ANCHOR = 4095  # in place of a length: not a chunk but a chosen gram
SLOTS_OF_IDS = 1 << 20


def _gears() -> np.ndarray:
    """A 16-bit number per byte, from a fixed multiplicative generator."""
    x, out = 0x2545F4914F6CDD1D, []
    for _ in range(256):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x >> 48)
    return np.array(out, np.uint16)


GEARS = _gears()
# The hash's top bits depend on the whole window; the lower ones on its end only.
CUT_MASK = np.uint16(((1 << CUT_BITS) - 1) << (WINDOW - CUT_BITS))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the rolling hash h = 2 h + gear[byte], modulo 2 ** WINDOW, for all bytes at once."""
    h = GEARS[data]
    for step in (1, 2, 4, 8):  # windows of 2, 4, 8 and 16 bytes from those of half the width
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Where chunks end: the first cut place that is LEAST bytes on, and MOST bytes on at the latest."""
    places = np.flatnonzero((gear_hashes(data) & CUT_MASK) == 0) + 1
    out, last = [], 0
    for place in places.tolist():
        if place - last < LEAST:
            continue
        while place - last > MOST:
            last += MOST
            out.append(last)
        if place - last >= LEAST:
            out.append(place)
            last = place
    while len(data) - last > MOST:
        last += MOST
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the bytes of each GRAM words in a row, with the byte where each begins and the one after it."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    n = len(starts) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64), starts[:0], ends[:0]
    data, space = data[starts[0] :], space[starts[0] :]
    offset = np.arange(len(data)) - np.repeat(starts - starts[0], np.diff(np.append(starts - starts[0], len(data))))
    factors = _mixed(np.arange(1, offset.max() + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    values = (data.astype(np.uint64) + np.uint64(1)) * factors[offset]
    spaced = _mixed(np.add.reduceat(values, starts - starts[0]))  # with the white space that follows
    values[space] = 0
    bare = _mixed(np.add.reduceat(values, starts - starts[0]))
    digests = spaced[:n].copy()
    for k in range(1, GRAM):
        digests = digests * np.uint64(0x9E3779B97F4A7C15) + (spaced if k < GRAM - 1 else bare)[k : k + n]
    return _mixed(digests), starts[:n], ends[GRAM - 1 :]


def chosen(digests: np.ndarray) -> np.ndarray:
    """Places of the least digest, the last of equal ones, in every PASSAGE_WORDS words."""
    width, low = NEAR + 1, np.uint64(0xFFFFFFFF)
    if len(digests) < width:
        return np.empty(0, np.int64)
    least, n = (digests & ~low) | (low - np.arange(len(digests), dtype=np.uint64)), 1
    while n < width:
        step = min(n, width - n)
        least, n = np.minimum(least[:-step], least[step:]), n + step
    places = (low - (least & low)).astype(np.int64)
    return places[np.concatenate([[True], np.diff(places) > 0])]


def chunk(text: str) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Digests of a text's chunks, with first and last code point and words begun in each.

    A last chunk under LEAST bytes says too little and is left out.
    """
    import xxhash

    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    ends = cuts(data)
    if ends and ends[-1] - (ends[-2] if len(ends) > 1 else 0) < LEAST:
        ends.pop()
    bounds = [0, *ends]
    digests = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(bounds, ends)]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begun = ~space & np.concatenate([[True], space[:-1]])
    words = np.concatenate([[0], np.cumsum(begun)])[bounds]
    return digests, points[:-1], points[1:], np.diff(words)


def _code_points(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[places]


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Digests of a text's chosen grams and the code points where they begin."""
    data = np.frombuffer(text.encode(), np.uint8)
    digests, starts, _ = grams(data)
    places = chosen(digests)
    return digests[places], _code_points(data, starts[places])


def with_chunks(text: str | Column) -> Column:
    """A text's chunks and chosen grams as ``digests`` and ``places``.

    A place packs first code point, length and words, with ANCHOR for the length of a gram.
    """

    @F.arrow_udf("struct<digests:array<bigint>,places:array<bigint>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ends, digests, places = [0], [], [np.empty(0, np.int64)]
            for t in texts:
                d, first, last, words = chunk(t.as_py() or "")
                g, start = anchors(t.as_py() or "")
                digests += [np.array(d, np.uint64).view(np.int64), g.view(np.int64)]
                places.append((first.astype(np.int64) << 20) | ((last - first) << 8) | np.minimum(words, 255))
                places.append((start.astype(np.int64) << 20) | (ANCHOR << 8))
                ends.append(ends[-1] + len(d) + len(g))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, np.concatenate(x)) for x in ([np.empty(0, np.int64), *digests], places)]
            yield pa.StructArray.from_arrays(lists, names=["digests", "places"])

    return cut(text)


def with_grams(text: str | Column, near: str | Column, told: str | Column) -> Column:
    """All grams of a text that begin up to NEAR words from a code point in ``near``.

    ``at`` is a gram's number in the text; ``told`` says whether it begins in one of the spans ``told``.
    """

    @F.arrow_udf("array<struct<digest:bigint,at:bigint,start:bigint,end:bigint,told:boolean>>")
    def list_grams(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, nears, tolds in batches:
            ends, parts = [0], [[np.empty(0, np.int64)] * 4 + [np.empty(0, bool)]]
            for t, near, told in zip(texts, nears, tolds):
                data = np.frombuffer((t.as_py() or "").encode(), np.uint8)
                digests, first, last = grams(data)
                first, last = _code_points(data, first), _code_points(data, last)
                marks = np.zeros(len(digests) + 1, np.int64)
                here = np.searchsorted(first, np.array(near.as_py() or [], np.int64))
                np.add.at(marks, np.clip(here - NEAR, 0, len(digests)), 1)
                np.add.at(marks, np.clip(here + NEAR + 1, 0, len(digests)), -1)
                at = np.flatnonzero(np.cumsum(marks)[:-1])
                seen = np.zeros(len(digests), bool)
                for span in told.as_py() or []:
                    seen[np.searchsorted(first, span["start"]) : np.searchsorted(first, span["end"])] = True
                parts.append([digests[at].view(np.int64), at, first[at], last[at], seen[at]])
                ends.append(ends[-1] + len(at))
            columns = [pa.array(np.concatenate(x)) for x in zip(*parts)]
            rows = pa.StructArray.from_arrays(columns, names=["digest", "at", "start", "end", "told"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return list_grams(text, near, told)


def _slot(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SLOTS_OF_IDS)).cast("int")


def _spans(passages: DataFrame) -> DataFrame:
    """``_id`` and ``_spans`` in order, as many as a document has passages."""
    spans = passages.select(F.col("doc_id").alias("_id"), F.struct("start", "end").alias("span")).distinct()
    return spans.groupBy("_id").agg(F.sort_array(F.collect_list("span")).alias("_spans"))


def _untold(docs: DataFrame, cut: DataFrame, again: DataFrame, told: DataFrame) -> DataFrame:
    """Passages of PASSAGE_WORDS or more, word by word, that the runs of chunks in ``told`` leave out.

    Each gram chosen in them that stands in no run makes all documents with it be read again, near it only.  A passage
    is a run of grams that smaller ids have as well.
    """
    spans = stage(_spans(told), "sub-told")
    inside = F.exists(F.coalesce("_spans", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda s: (s.start <= F.col("start")) & (F.col("start") < s.end))
    left = again.where("anchor").join(spans, again["doc_id"] == spans["_id"], "left").where(~inside)
    open_grams = stage(left.select("digest").distinct(), "sub-open")
    # What later steps do not read goes at once: the peak of the disk is not the sum of all steps.
    unstage(again)
    near = (
        cut.select("doc_id", F.explode(F.arrays_zip("digests", "places")).alias("c"))
        .select("doc_id", F.col("c.digests").alias("digest"), F.col("c.places").alias("place"))
        .where(F.shiftright("place", 8).bitwiseAND(F.lit(4095)) == ANCHOR)
        .join(open_grams, "digest")
        .groupBy("doc_id")
        .agg(F.collect_set(F.shiftright("place", 20)).alias("near"))  # as many as the document has chosen grams
        .withColumnRenamed("doc_id", "_doc")
    )
    near = stage(near.join(spans, near["_doc"] == spans["_id"], "left").drop("_id"), "sub-near")
    unstage(cut, open_grams, spans)
    # The broadcast side has SLOTS_OF_IDS rows of one number at most; it spares most documents the shuffle.
    slots = near.select(_slot("_doc").alias("slot")).distinct()
    likely = docs.join(F.broadcast(slots), _slot("doc_id") == F.col("slot"), "left_semi")
    read = likely.join(near, likely["doc_id"] == near["_doc"]).select("doc_id", with_grams("text", "near", "_spans").alias("g"))
    listed = stage(read.select("doc_id", F.explode("g").alias("g")).select("doc_id", "g.*"), "sub-grams")
    unstage(near)
    holders = listed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    holders = stage(holders.select("digest", "first"), "sub-gram-holders")
    repeated = listed.join(holders, "digest").where("doc_id > first").select("doc_id", "first", "at", "start", "end", "told").distinct()
    in_order = Window.partitionBy("doc_id").orderBy("at", "start", "end", "first")
    runs = repeated.withColumn("new", F.when(F.col("at") <= F.lag("at").over(in_order) + 1, 0).otherwise(1)).withColumn(
        "run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    whole, by_words = Window.partitionBy("doc_id", "run"), Window.partitionBy("doc_id", "run").orderBy(F.desc("first_words"), "first")
    return (
        runs.groupBy("doc_id", "run", "first")
        .agg(
            F.min("start").alias("_start"), F.max("end").alias("_end"), F.min("at").alias("_low"), F.max("at").alias("_high"),
            F.countDistinct("at").alias("grams"), F.countDistinct(F.when(F.col("told"), F.col("at"))).alias("_told"),
        )
        .withColumns(
            {
                "start": F.min("_start").over(whole), "end": F.max("_end").over(whole), "told": F.sum("_told").over(whole),
                "n": F.max("_high").over(whole) - F.min("_low").over(whole) + 1, "last": F.max("_high").over(whole) == F.col("_high"),
            }
        )
        .withColumn("first_words", F.col("grams") + F.when(F.col("last"), GRAM - 1).otherwise(0))
        .withColumn("place", F.row_number().over(by_words))
        # Not what a run of chunks tells of in part, unless that leaves a passage.
        .where((F.col("n") > NEAR) & ((F.col("told") < RUN_WORDS // 2) | (F.col("n") - F.col("told") > NEAR)))
        .where((F.col("place") == 1) | (F.col("first_words") >= SOURCE_WORDS))
        .select("doc_id", F.col("first").alias("first_doc_id"), "start", "end", (F.col("n") + GRAM - 1).alias("n_words"), "first_words")
    )


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """Passages of ``docs`` that a document with a smaller id has as well.

    Returns ``doc_id``, ``first_doc_id``, ``start`` and exclusive ``end`` in code points, ``n_words`` of the whole
    passage and ``first_words`` shared with that first document; a passage has a row for each first document of enough of it.
    Repeats within one document are not reported.  Null and empty texts have no passages; rows without an id
    take no part; rows that repeat an id are one document.  Other columns are not read.

    A run of chunks of ``run_words`` makes a passage, told from its first shared chunk to its last.  One of PASSAGE_WORDS
    whole words or more that leaves no such run is told from its first shared word to its last.

    A text is read once, and again where chosen grams are shared outside such runs.  What is shuffled is digests with ids
    and places, and the texts read again; holders of a digest are counted with
    combining before the shuffle, and the join back is of two shuffled tables, which the adaptive
    planner splits where many documents hold one chunk.
    """
    plain = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    cut = stage(plain.select("doc_id", with_chunks("text").alias("c")).select("doc_id", "c.*"), "sub-chunks")
    holders = (
        cut.select("doc_id", F.explode("digests").alias("digest"))
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select("digest", "first")
    )
    holders = stage(holders, "sub-holders")
    placed = cut.select("doc_id", F.explode(F.arrays_zip("digests", "places")).alias("c")).select(
        "doc_id", F.col("c.digests").alias("digest"), F.col("c.places").alias("place")
    )
    start = F.shiftright("place", 20)
    length = F.shiftright("place", 8).bitwiseAND(F.lit(4095))
    again = (
        placed.join(holders, "digest")
        .where("doc_id > first")
        .select(
            "doc_id", "first", "digest", start.alias("start"),
            (start + length).alias("end"), F.col("place").bitwiseAND(F.lit(255)).alias("words"), (length == ANCHOR).alias("anchor"),
        )
    )
    again = stage(again, "sub-again")
    unstage(holders)
    in_order = Window.partitionBy("doc_id").orderBy("start", "end", "digest")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    # A row that repeats another one, id and text, adds no words.
    row = F.struct("start", "end", "digest")
    opened = again.where("not anchor").withColumns(
        {"new": F.when(F.col("start") <= before, 0).otherwise(1), "words": F.when(F.lag(row).over(in_order) == row, 0).otherwise(F.col("words"))}
    )
    runs = opened.withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    whole, by_words = Window.partitionBy("doc_id", "run"), Window.partitionBy("doc_id", "run").orderBy(F.desc("first_words"), "first")
    told = (
        runs.groupBy("doc_id", "run", "first")
        .agg(F.min("start").alias("_start"), F.max("end").alias("_end"), F.sum("words").alias("first_words"))
        .withColumns(
            {
                "n_words": F.sum("first_words").over(whole), "start": F.min("_start").over(whole), "end": F.max("_end").over(whole),
                "place": F.row_number().over(by_words),
            }
        )
        .where((F.col("n_words") >= run_words) & ((F.col("place") == 1) | (F.col("first_words") >= SOURCE_WORDS)))
        .select("doc_id", F.col("first").alias("first_doc_id"), F.col("start").cast("bigint"), F.col("end").cast("bigint"), "n_words", "first_words")
    )
    told = stage(told, "sub-runs")
    return told.unionByName(_untold(plain, cut, again, told))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with the repeated passages cut out of their texts; the first document keeps them.

    All rows and columns stay; a text that is repeated whole becomes what is left of it.
    """
    theirs, cuts = unused(docs.columns, "_id", "_spans")
    spans = stage(_spans(repeated_passages(docs, doc_id, text, run_words)), "sub-spans").toDF(theirs, cuts)
    body = F.col(text)
    kept = F.aggregate(
        cuts,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("done")),
        lambda a, s: F.struct(
            F.greatest(a.at, s.end).alias("at"), F.concat(a.done, F.substring(body, (a.at + 1).cast("int"), (s.start - a.at).cast("int"))).alias("done")
        ),
        lambda a: F.concat(a.done, F.substring(body, (a.at + 1).cast("int"), F.length(body))),
    )
    joined = docs.join(spans, docs[doc_id] == spans[theirs], "left")
    return joined.select(*[F.when(F.col(cuts).isNull(), body).otherwise(kept).alias(text) if c == text else docs[c] for c in docs.columns])


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(table(spark, folder, "documents"))
