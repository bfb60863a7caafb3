"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A document's set of word shingles gives a signature of SLOTS values of SLOT_BITS bits.  The signature
is cut into CHUNKS; by the pigeonhole principle two signatures that differ in fewer than
(ERRORS + 1) * CHUNKS slots differ in at most ERRORS slots of some chunk.  Each chunk is therefore
posted once for every choice of ERRORS slots left out, and two documents meet wherever a posted key is
the same: all pairs under that distance, whatever the values of the slots left out.  Documents that
meet are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.llm.catalog import query, table
from fleetstats.llm.components import components
from fleetstats.plans.staging import stage

WORDS, PERCENT = 5, 80  # five words a shingle and a similarity of 0.8, unless a contract says otherwise
SLOTS, CHUNKS, ERRORS, SLOT_BITS = 72, 12, 1, 16
# All pairs of fewer differing slots meet.  A pair of similarity s differs in a slot with chance 1 - s;
# at 0.8 it meets in none of the chunks with chance 0.345 ** 12, under 3 in a million.
CERTAIN = (ERRORS + 1) * CHUNKS
# One bit of each of 64 slots goes along with a key.  At 0.8 six of them differ on average, and more than
# this with a chance of one in 10 ** 8; such pairs are not looked at further.
FAR_BITS = 24
# Passes that compare each bucket's documents with one of them, before all that is left is compared.
STARS = 2
# A set is also kept as a mask of this many 64-bit words, one bit per range of hashes that it has a shingle in.
MASK_WORDS = 8
# Documents are read again for their full sets; a table of at most this many slots of ids says which may be needed.
SLOTS_OF_IDS = 1 << 20
REMEMBERED = 200_000  # word hashes that a Python worker remembers
SEED = 0x9E3779B97F4A7C15
KNOWN = ("n", "bits", "common", "mask")  # of a document, beside each key that it is posted under


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def _constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit values."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes, and their signatures."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.hashes = _WordHashes()
        self.place = _constants(words, SEED)
        self.times, self.plus = _constants(SLOTS, SEED ^ 0x55), _mixed(_constants(SLOTS, SEED ^ 0x77))

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct shingles; fewer words than a shingle has are one, no words are none."""
        split = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space
        if not split:
            return np.empty(0, np.uint64)
        if len(self.hashes) > REMEMBERED:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, split), np.uint64, len(split))
        n = min(self.words, len(h))
        joined = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            joined += h[i : len(h) - n + 1 + i] * self.place[i]
        return np.unique(_mixed(joined))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        lowest = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048, None]
            np.minimum(lowest, (part * self.times + self.plus).min(axis=0), out=lowest)
        return (_mixed(lowest) & np.uint64((1 << SLOT_BITS) - 1)).astype("<u2")


def _set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    import xxhash

    hi, lo = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8")
    return int(hi), int(lo)


def sketch(text: Column, words: int) -> Column:
    """Of a text: ``n`` shingles, two 64-bit hashes of the whole set, its ``signature`` and 64 bits of that."""

    @F.arrow_udf("struct<n:bigint,hi:bigint,lo:bigint,bits:bigint,signature:binary>")
    def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = Shingler(words)
        kind = pa.struct([("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("bits", pa.int64()), ("signature", pa.binary())])
        for texts in batches:
            rows = []
            for t in texts:
                s = shingler.shingles(t.as_py())
                signature = shingler.signature(s)
                hi, lo = _set_hashes(s)
                bits = np.packbits(signature[:64] & 1).view("<i8")[0]
                rows.append({"n": len(s), "hi": hi, "lo": lo, "bits": int(bits), "signature": signature.tobytes()})
            yield pa.array(rows, kind)

    return sketched(text)


def shingle_set(text: Column, words: int) -> Column:
    """The full set of a text, with the hashes that ``sketch`` gives it and its mask."""

    @F.arrow_udf("struct<shingles:array<bigint>,hi:bigint,lo:bigint,mask:array<bigint>>")
    def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = Shingler(words)
        for texts in batches:
            sets = [shingler.shingles(t.as_py()) for t in texts]
            hashes = np.array([_set_hashes(s) for s in sets], np.int64).reshape(-1, 2)
            ranges = np.uint64(64 - (64 * MASK_WORDS - 1).bit_length())
            masks = [np.packbits(np.bincount((s >> ranges).astype(np.int64), minlength=64 * MASK_WORDS) > 0).view("<i8") for s in sets]
            kind = pa.list_(pa.int64())
            columns = [pa.array([s.view(np.int64) for s in sets], kind), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(masks, kind)]
            yield pa.StructArray.from_arrays(columns, names=["shingles", "hi", "lo", "mask"])

    return listed(text)


def _left_out() -> list[tuple[int, list[int]]]:
    """Per posted key its chunk and the slots that it holds."""
    bounds = np.linspace(0, SLOTS, CHUNKS + 1).round().astype(int)
    return [
        (c, [s for s in range(bounds[c], bounds[c + 1]) if s not in out])
        for c in range(CHUNKS)
        for out in combinations(range(bounds[c], bounds[c + 1]), ERRORS)
    ]


def posted_keys(signature: str | Column) -> Column:
    """The keys under which a signature is posted, one per chunk and choice of slots left out."""

    @F.arrow_udf("array<bigint>")
    def keys(signatures: pa.Array) -> pa.Array:
        slots = np.array([np.frombuffer(s.as_py(), "<u2") for s in signatures], np.uint64).reshape(-1, SLOTS)
        held = _left_out()
        factors = _constants(SLOTS, SEED ^ 0x99)
        out = np.empty((len(slots), len(held)), np.uint64)
        for i, (_, places) in enumerate(held):
            out[:, i] = _mixed((_mixed(slots[:, places] + factors[places]) * factors[: len(places)]).sum(axis=1, dtype=np.uint64) + np.uint64(i + 1))
        ends = np.arange(len(slots) + 1, dtype=np.int32) * len(held)
        return pa.ListArray.from_arrays(ends, out.view(np.int64).ravel())

    return keys(signature)


def _close(a: str, b: str, percent: int) -> Column:
    """Whether what is known of two rows allows the similarity.

    ``common`` of a row's ``n`` shingles are in any other set, so no pair shares more than the smaller of two; nor
    does it share the shingles of one in ranges where the other has none, of which there is one per bit at least.
    """

    def alone(one: str, other: str) -> Column:
        bits = [F.bit_count(F.col(one)["mask"][i].bitwiseAND(F.bitwise_not(F.col(other)["mask"][i]))) for i in range(MASK_WORDS)]
        return F.col(one)["n"] - F.coalesce(sum(bits[1:], bits[0]), F.lit(0))

    most = F.least(f"{a}.common", f"{b}.common", alone(a, b), alone(b, a))
    far = F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits")))
    return (most * 100 >= (F.col(f"{a}.n") + F.col(f"{b}.n") - most) * percent) & (far <= FAR_BITS)


def _slot(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SLOTS_OF_IDS)).cast("int")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full ``sets`` (node, shingles) are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("_shared", shared)
        .where(F.col("_shared") * 100 >= (F.size("_a") + F.size("_b") - F.col("_shared")) * percent)
        .select("a", "b")
    )


def near_links(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that give the components of all links between ``nodes`` (node, n, bits, signature, hi, lo).

    Buckets are the documents posted under one key.  First each is compared with its bucket's first, so a
    group of n near copies costs some n comparisons.  Then only documents of different components are
    compared: in a second pass with another one of the bucket's largest component, and at last
    each document outside it with all of its bucket, so that no link between components is lost.
    """
    # Keys held by one document only are most of them; they are gone after one counted shuffle.
    posted = nodes.select("node", "n", "bits", F.explode(posted_keys("signature")).alias("key"))
    shared = posted.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    shared = stage(shared.where("first < last"), "near-buckets")
    held = stage(posted.join(shared, "key").select("key", "first", "node", "n", "bits"), "near-held")
    used = stage(nodes.join(held.select("node").distinct(), "node", "left_semi").select("node", "hi", "lo"), "near-used")
    # The broadcast side has SLOTS_OF_IDS rows of one number at most; it spares most documents the shuffle.
    slots = used.select(_slot("node").alias("slot")).distinct()
    likely = docs.join(F.broadcast(slots), _slot("doc_id") == F.col("slot"), "left_semi")
    full = likely.join(used, likely["doc_id"] == used["node"]).select(
        "node", F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), shingle_set(F.col("text"), words).alias("s")
    )
    sets = stage(full.select("node", "_hi", "_lo", "s.*"), "near-sets").where("hi = _hi and lo = _lo")
    # A shingle of one set only is shared with none.  Sets with too many of them have no links at all.
    owners = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("sets"))
    own = owners.where("sets = 1").groupBy("node").agg(F.count("*").alias("own"))
    # Of an id with several sets nothing is known but that.
    known = sets.groupBy("node").agg(F.when(F.min("hi") == F.max("hi"), F.first("mask")).alias("mask"))
    known = stage(known.join(own, "node", "left"), "near-known")
    missing = F.when(F.col("mask").isNotNull(), F.col("own"))
    held = held.join(known, "node").withColumn("common", F.col("n") - F.coalesce(missing, F.lit(0)))
    held = stage(held.where(F.col("common") * 100 >= F.col("n") * percent).drop("own", "first"), "near-held")
    firsts = held.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    held = held.join(stage(firsts.select("key", "first"), "near-firsts"), "key")
    held = stage(held.select("key", "first", "node", *KNOWN), "near-held")

    known = held.select(F.col("node").alias("first"), F.struct(*KNOWN).alias("f")).distinct()
    pairs = (
        held.where("first <> node")
        .select("first", "node", F.struct(*KNOWN).alias("o"))
        .distinct()
        .join(known, "first")
        .where(_close("f", "o", percent))
        .select(F.col("first").alias("a"), F.col("node").alias("b"))
    )
    compared = stage(pairs.distinct(), "near-pairs")
    links = stage(confirmed(compared, sets, percent), "near-links")
    for star in range(1, STARS + 1):
        mixed, major = _mixed_buckets(held, links)
        if star < STARS:
            lead = mixed.where("label = major").groupBy("key").agg(
                F.min_by(F.struct("node", *KNOWN), F.xxhash64("node", F.lit(star))).alias("f")
            )
            others = mixed.where("label <> major").select("key", F.struct("node", *KNOWN).alias("o"))
            found = others.join(stage(lead, "near-leads"), "key").where(_close("f", "o", percent))
        else:
            # Two documents may meet in many buckets; they are compared in the first of those, and once.
            posts = mixed.groupBy("node", "n", "bits").agg(F.collect_set("key").alias("keys"))
            everyone = mixed.join(stage(posts, "near-posts"), ["node", "n", "bits"])
            everyone = stage(everyone.select("key", F.struct("node", *KNOWN, "label", "major", "keys").alias("f")), "near-everyone")
            outside = everyone.where("f.label <> f.major").withColumnRenamed("f", "o")
            once = (F.col("f.label") == F.col("f.major")) | (F.col("f.node") > F.col("o.node"))
            here = F.array_min(F.array_intersect("f.keys", "o.keys")) == F.col("key")
            found = outside.join(everyone, "key").where((F.col("f.label") != F.col("o.label")) & once & _close("f", "o", percent) & here)
        found = found.select(F.least("f.node", "o.node").alias("a"), F.greatest("f.node", "o.node").alias("b")).distinct()
        found = stage(found.join(compared, ["a", "b"], "left_anti"), "near-pairs")
        links = stage(links.union(confirmed(found, sets, percent)), "near-links")
        compared = compared.union(found)
    return links


def _mixed_buckets(held: DataFrame, links: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of ``held`` in buckets of several components, with the component's and the largest's label."""
    labels = components(links)
    labelled = held.join(labels, "node", "left").select(
        "key", "node", *KNOWN, F.coalesce("label", "node").alias("label")
    )
    labelled = stage(labelled, "near-labelled")
    sizes = labelled.groupBy("key", "label").count()
    several = (
        sizes.groupBy("key")
        .agg(F.max(F.struct("count", "label")).alias("most"), F.count("*").alias("labels"))
        .where("labels > 1")
        .select("key", F.col("most.label").alias("major"))
    )
    return stage(labelled.join(stage(several, "near-several"), "key"), "near-mixed"), F.col("major")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The group of near duplicates of each row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``
    (the smallest id reached by links) and ``kept``.

    A-Z are lower-cased and words end at ASCII white space.  Documents are linked when the intersection of their
    sets of shingles of ``words`` words is ``percent`` hundredths of the union or more.  A text with fewer words is one
    shingle; a null, empty or blank text has none and is linked with nothing.  Documents of equal sets are one
    node from the start.  Rows of one id are one document, with all their links.  A row
    without id takes no part: its component is null and it is kept.  Other columns are not read.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketched = docs.select("doc_id", sketch(F.col("text"), words).alias("s")).select("doc_id", "s.*")
    sketched = stage(sketched, "near-sketches")
    usable = sketched.where("n > 0 and doc_id is not null")
    classes = stage(usable.groupBy("hi", "lo").agg(F.min("doc_id").alias("node")), "near-classes")
    members = stage(usable.join(classes, ["hi", "lo"]).select("doc_id", "n", "bits", "signature", "hi", "lo", "node"), "near-members")
    nodes = members.where("doc_id = node").select("node", "n", "bits", "signature", "hi", "lo").dropDuplicates(["node", "hi", "lo"])
    links = near_links(docs, nodes, words, percent)
    # An id with several texts, or a text with several ids, ties their nodes together.
    repeated = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    texts = members.join(repeated.select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    labels = components(links.union(texts.where("a <> b")))
    nodes_of = members.select("doc_id", F.col("n").alias("n_shingles"), "node")
    grouped = nodes_of.join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id")
    )
    alone = sketched.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return grouped.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document stays, with their columns."""
    gone = stage(near_dedup(docs, doc_id, text, words, percent).where("not kept").select(F.col("doc_id").alias("_id")).distinct(), "near-gone")
    return docs.join(gone, docs[doc_id] == gone["_id"], "left_anti")


@query("op9_near_dedup")
def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup(table(spark, folder, "documents"), words=4, percent=80)
