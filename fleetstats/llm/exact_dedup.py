"""Exact dedup by chunk recipes.

A text is cut where its content says so, each chunk gets a short identifier, and two texts are equal
when their ordered identifier lists are.  The texts themselves are read once and never shuffled; what
moves is some ten bytes per chunk.  Everything here is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.llm.catalog import query, table
from fleetstats.llm.names import unused
from fleetstats.plans.staging import stage

# Chunks have LEAST to MOST characters; the last of a text may be shorter.
LEAST, MOST = 256, 8192
# A cut is after three characters of which each is of one of EIGHTHS classes of code points.
EIGHTHS, CLASSES, LAST_CODE = 8, (5, 4, 1), 0x24F
# So many doubtful identifiers are looked for one by one; beyond it every chunk is named by digest.
DOUBTFUL = 1000


def normalised(text: str | Column) -> Column:
    """The text with every run of white space made one space; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    # A lone space needs no change, so only other runs are looked for.
    runs = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(text, F.lit("")), runs, " ")


def _cut_pattern() -> str:
    def letters(rest: int) -> str:
        codes = range(33 + (rest - 33) % EIGHTHS, LAST_CODE + 1, EIGHTHS)
        return "[" + "".join(f"\\x{{{c:x}}}" for c in codes) + "]"

    cut = "".join(map(letters, CLASSES))
    return f"(?s).{{{LEAST - 3},{MOST - 3}}}?{cut}|.{{1,{MOST}}}"


def chunks(text: Column) -> Column:
    """The chunks of a text in order; put together they are the text.  An empty text has none."""
    return F.regexp_extract_all(text, F.lit(_cut_pattern()), F.lit(0))


def _part(digest: Column, start: int) -> Column:
    """60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")


def chunked(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with ``text_sha256`` and ``chunks``: per chunk a short ``id`` and 120 bits of its
    SHA-256 as ``hi`` and ``lo``."""
    name = F.transform("_chunks", lambda c: F.struct(F.xxhash64(c).alias("id"), F.sha2(c.cast("binary"), 256).alias("d")))
    return (
        docs.select(*[F.col(k) for k in keep], normalised(text).alias("_text"))
        .select(*keep, F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"), chunks(F.col("_text")).alias("_chunks"))
        .select(*keep, "text_sha256", name.alias("_named"))
        .select(
            *keep,
            "text_sha256",
            F.transform("_named", lambda c: F.struct(c.id.alias("id"), _part(c.d, 1).alias("hi"), _part(c.d, 16).alias("lo"))).alias("chunks"),
        )
    )


def chunk_store(chunked_docs: DataFrame) -> DataFrame:
    """One row per short identifier: how often it is used, and whether one chunk alone uses it.

    An identifier is verified when all its chunks have one digest.  Counts combine before the
    shuffle, so a chunk that a third of all documents hold is one row per task there.
    """
    each = chunked_docs.select(F.explode("chunks").alias("c"))
    return (
        each.groupBy(F.col("c.id").alias("id"))
        .agg(
            F.count("*").alias("uses"),
            (
                (F.min("c.hi") == F.max("c.hi")) & (F.min("c.lo") == F.max("c.lo"))
            ).alias("verified"),
        )
    )


def recipes(chunked_docs: DataFrame) -> DataFrame:
    """``chunked_docs`` with ``recipe``, the ordered list of verified identifiers.

    A chunk's short identifier serves if the chunk store verifies it.  A document that holds an
    unverified one lists identifiers and digests; no document without it can have the same list.
    """
    doubtful = chunk_store(chunked_docs).where(~F.col("verified")).limit(DOUBTFUL + 1)
    ids = [r.id for r in doubtful.select("id").collect()]
    short = F.transform("chunks", lambda c: c.id)
    long = F.flatten(F.transform("chunks", lambda c: F.array(c.id, c.hi, c.lo)))
    if not ids:
        return chunked_docs.withColumn("recipe", short)
    if len(ids) > DOUBTFUL:
        return chunked_docs.withColumn("recipe", long)
    held = F.arrays_overlap(short, F.array(*[F.lit(i) for i in ids]))
    return chunked_docs.withColumn("recipe", F.when(held, long).otherwise(short))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Which document stays of each group of equal texts, one row per row of ``docs``.

    Texts are equal when identical after each run of white space is made one space; a null text is
    an empty one, and all empty texts are equal.  Returns ``doc_id``, ``keep_id`` (the group's smallest
    doc_id; null if the group has none), ``group_size`` in rows, ``kept`` and ``text_sha256``.  Rows that repeat
    a doc_id together with its text are one document and get the same answer, so both are kept or
    neither.  A row without doc_id is never kept unless its whole group has none.  Other columns,
    whatever their names, are not read.  An empty table gives no rows.

    Groups are counted with combining before the shuffle.  Only groups of two and more are joined
    back, on the recipe; both sides are shuffled tables of known size, so the adaptive planner splits
    a recipe that a third of all rows have.
    """
    named = stage(chunked(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "exact-chunks")
    listed = recipes(named).select("doc_id", "text_sha256", "recipe")
    groups = stage(
        listed.groupBy("recipe")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where(F.col("group_size") > 1),
        "exact-groups",
    )
    own = F.col("group_size").isNull()
    keep_id = F.when(own, F.col("doc_id")).otherwise(F.col("keep_id"))
    return listed.join(groups, "recipe", "left").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one.

    Ids decide which rows stay, so a document is not moved to be kept.  Only documents whose id is
    there more than once are told apart by their text as well.
    """
    answers = stage(exact_dedup(docs, doc_id, text), "exact-answers")
    theirs, rows, stays, sha, digest = unused(docs.columns, "_id", "_rows", "_kept", "_sha", "_digest")
    ids = answers.groupBy(F.col("doc_id").alias(theirs)).agg(F.count("*").alias(rows), F.max("kept").alias(stays))
    ids = stage(ids.where((F.col(rows) > 1) | ~F.col(stays)), "exact-odd-ids")
    same = docs[doc_id].eqNullSafe(F.col(theirs))
    plain = docs.join(ids, same, "left_anti")
    kept = answers.where("kept").select(F.col("doc_id").alias(theirs), F.col("text_sha256").alias(digest)).distinct()
    several = docs.join(ids.where(stays), same, "left_semi").withColumn(sha, F.sha2(normalised(text).cast("binary"), 256))
    several = several.join(
        kept, several[doc_id].eqNullSafe(F.col(theirs)) & (F.col(sha) == F.col(digest)), "left_semi"
    )
    return plain.unionByName(several.dropDuplicates([doc_id, sha]).drop(sha))


SPACES = "[ \\t\\n\\x0B\\f\\r]+"

SQL = f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""


@query("op8_exact_dedup", SQL)
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))
