"""Conversation structure repair: the cheapest edits that give each conversation its alternating roles.

Faults are found with windows.  A conversation of ordinary size is repaired as its rows stream by in
order.  A longer one is cut into pieces, which are solved side by side for every pair of states at their borders and
chained; then its rows stream by as well.  No conversation's texts are ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetstats.llm import edit_lattice
from fleetstats.llm.batches import Batches, arrow_schema
from fleetstats.llm.catalog import query, table
from fleetstats.llm.edit_lattice import FINAL, INSERT, KEPT, MUST_GO, PUT, TRUNCATED, chain, cheapest_whole, crossings
from fleetstats.plans.slices import join_same
from fleetstats.plans.staging import stage

SPACE = " \t\n\x0b\x0c\r"
PIECE = 1024  # rows of a conversation that are solved at once
PIECE_CHARS = 16 * 2**20  # and the text that is held for them
STATE_ROLE = {2: "user", 3: "assistant"}
ROWS = ("conv_id", "turn", "role", "text", "fault")
EDITS = "place bigint, turn bigint, edit string, fault string, was string, role string, text string, cost bigint"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations in which crc32 of ``conv_id:turn`` decides the fault of each row.

    Of its remainder by 20, 0 drops the row, 1 empties the text, 2 takes out ``.!?``, 3 repeats it, 4 makes it a
    user's.  Nulls in role and text, and in the hashed pair, are one space; a null turn stays null.
    """
    space = F.lit(" ")
    pair = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, text = F.col("kind"), F.coalesce("text", space)
    rows = conversations.withColumn("kind", F.crc32(pair.cast("binary")) % 20).where("kind <> 0")
    return rows.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Each row's first fault: blank, duplicate, truncated, or an empty string."""
    core = F.rtrim("text", F.lit(SPACE))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    fault = (
        F.when(core == "", "blank").when(F.col("seen") > 1, "duplicate")
        .when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    )
    return rows.withColumn("seen", seen).withColumn("fault", fault)


def _order() -> list[Column]:
    """Turn, missing ones first; ties by role, text, and what repeats last."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("seen")]


def _code() -> Column:
    initial = F.left("role", F.lit(1))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)


class _Editor:
    """Applies the letters of an audit to the rows of one conversation as they come."""

    def __init__(self, conv):
        self.conv, self.state, self.place, self.letters, self.at = conv, 0, 0, "", 0

    def given(self, letters: str) -> None:
        self.letters, self.at = self.letters[self.at :] + letters, 0

    def _row(self, turn, edit, fault, was, role, text, cost) -> tuple:
        self.place += 1
        return self.conv, self.place, turn, edit, fault, was, role, text, cost

    def inserts(self) -> Iterator[tuple]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            self.state = PUT[self.state]
            yield self._row(None, "I", None, None, STATE_ROLE[self.state], "", INSERT)

    def row(self, turn, role, text, fault) -> Iterator[tuple]:
        yield from self.inserts()
        edit = self.letters[self.at]
        self.at += 1
        extra = TRUNCATED * (fault == "truncated")
        if edit == "D":
            yield self._row(turn, edit, fault, role, None, None, edit_lattice.DELETE)
        elif edit == "R":
            self.state = PUT[self.state]
            yield self._row(turn, edit, fault, role, STATE_ROLE[self.state], text, edit_lattice.REROLE + extra)
        else:
            self.state = KEPT[self.state, role[0]]
            yield self._row(turn, edit, fault, role, role, text, edit_lattice.KEEP + extra)


def _editing(schema: str, letters_given: bool):
    """The streaming repair.  Rows come whole conversations at a time, in order.

    With ``letters_given``, each piece's letters come in a row of their own ahead of the piece; without, a conversation's rows
    are held until it ends, and solved.
    """

    returned = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(returned)
        editor, held = None, []

        def finish() -> Iterator[tuple]:
            if editor is None:
                return
            if not letters_given:
                editor.given(cheapest_whole("".join(h[0] for h in held))[1])
                for _, *row in held:
                    yield from editor.row(*row)
            yield from editor.inserts()

        for batch in batches:
            for conv, turn, role, text, fault, code in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if editor is None or conv != editor.conv:
                    for row in finish():
                        yield from out.add(row, len(row[7] or ""))
                    editor, held = _Editor(conv), []
                if not letters_given:
                    held.append((code, turn, role, text, fault))
                elif fault is None:
                    editor.given(code)
                else:
                    for row in editor.row(turn, role, text, fault):
                        yield from out.add(row, len(row[7] or ""))
        for row in finish():
            yield from out.add(row, len(row[7] or ""))
        yield from out.flush()

    return run


def _letters(pieces: DataFrame, piece: int) -> DataFrame:
    """(conv_id, piece, letters): each piece's part of its conversation's audit, from the codes of its rows."""

    schema = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, piece bigint, letters string"
    out_type = arrow_schema(schema)

    @F.udf("array<struct<start:int,end:int,cost:bigint,audit:string>>")
    def solved(codes):
        return crossings(codes)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, paths, begun = None, {}, False

        def ended() -> Iterator[pa.RecordBatch]:
            if begun:
                audit = min(paths[s] for s in FINAL if s in paths)[1]
                cuts, rows = [0], 0
                for i, letter in enumerate(audit):
                    rows += letter != "I"
                    if letter != "I" and rows % piece == 0:
                        cuts.append(i + 1)
                if cuts[-1] < len(audit):
                    # Inserts behind the last row belong to the last piece.
                    if set(audit[cuts[-1] :]) == {"I"}:
                        cuts.pop()
                    cuts.append(len(audit))
                parts = [audit[a:b] for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv] * len(parts), out_type.field(0).type), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())],
                    schema=out_type,
                )

        for batch in batches:
            for at, ways in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not begun or at != conv:
                    yield from ended()
                    conv, paths, begun = at, {0: (0, "")}, True
                paths = chain(paths, [(w["start"], w["end"], w["cost"], w["audit"]) for w in ways])
        yield from ended()

    ways = stage(pieces.select("conv_id", "piece", solved("codes").alias("ways")), "conversation-pieces")
    return ways.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(chained, schema)


def repair(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    piece: int = PIECE, piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """The edits of each conversation, one row each, in order within a partition and a conversation never in two.

    Columns: ``conv_id``; ``place`` from 1; ``turn``; ``edit`` K (keep), R (rerole), D (delete) or I (insert); ``fault`` blank,
    duplicate, truncated or empty; ``was`` the role before, null for inserts; ``role`` and ``text`` after, null for deleted rows;
    ``cost``.  Rows that are not deleted are the repaired conversation; its role initials are ``(s?(ua)+)?``.

    Rows of a conversation are ordered by turn, missing ones first, then by role and text.  Null roles and texts are one space.
    A null ``conv_id`` is a conversation like any other.  Blank rows hold only space, duplicates repeat role and text of an earlier
    row, truncated ones end in none of ``.!?``.  Of the cheapest edits the least audit is taken.  Other columns are not
    read.  Without rows there are no edits.

    Conversations of more than ``piece`` rows or ``piece_chars`` characters are solved in pieces.  Their rows are ordered by one task each.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text"),
    )
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {EDITS}"
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))
    long = stage(sizes.where((F.col("rows") > piece) | (F.col("chars") > piece_chars)).select("conv_id"), "long-conversations")
    some_long = not long.isEmpty()
    columns = ["conv_id", "turn", "role", "text", "fault", "code"]
    ordinary = join_same(rows, long, ["conv_id"], "left_anti") if some_long else rows
    # Faults and the order are both found where the conversation's one shuffle has brought its rows.
    ordinary = _faults(ordinary.repartition("conv_id")).sortWithinPartitions("conv_id", *_order())
    edits = ordinary.select(*ROWS, _code().alias("code")).mapInArrow(_editing(schema, False), schema)
    if not some_long:
        return edits
    placed = _faults(join_same(rows, long, ["conv_id"], "left_semi"))
    placed = placed.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy(*_order())) - 1)
    placed = stage(placed.select(*ROWS, _code().alias("code"), F.col("pos").cast("bigint").alias("pos")), "long-rows")
    in_piece = placed.groupBy("conv_id", F.floor(F.col("pos") / piece).alias("piece"))
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x.code), "")
    letters = _letters(in_piece.agg(codes.alias("codes")), piece)
    none = F.lit(None)
    heads = letters.select(
        "conv_id", none.cast("bigint").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"),
        none.cast("string").alias("fault"), F.col("letters").alias("code"), (F.col("piece") * piece).alias("pos"),
    )
    both = placed.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "pos", F.col("fault").asc_nulls_first())
    return edits.unionByName(both.select(*columns).mapInArrow(_editing(schema, True), schema))


SUMMARY = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
)


def summaries(edits: DataFrame) -> DataFrame:
    """One row per conversation of what ``repair`` returned, as it stands in its partitions: counts, cost, audit and digest."""
    schema = f"conv_id {edits.schema['conv_id'].dataType.simpleString()}, {SUMMARY}"

    returned = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(returned)
        now = None
        for batch in batches:
            names = ("conv_id", "turn", "edit", "fault", "was", "role", "text", "cost")
            for conv, turn, edit, fault, was, role, text, cost in zip(*(batch.column(n).to_pylist() for n in names)):
                if now is None or now.conv != conv:
                    if now:
                        yield from out.add(now.row(), len(now.audit))
                    now = _Summary(conv)
                now.take(turn, edit, fault, was, role, text, cost)
        if now:
            yield from out.add(now.row(), len(now.audit))
        yield from out.flush()

    return edits.mapInArrow(run, schema)


class _Summary:
    """Counts of one conversation as its edits come; nothing of its texts is kept."""

    def __init__(self, conv):
        self.conv, self.audit, self.cost, self.illegal = conv, [], 0, 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.sha, self.first, self.before = hashlib.sha256(), True, None
        self.low = self.high = None
        self.turns = 0

    def take(self, turn, edit, fault, was, role, text, cost) -> None:
        self.audit.append(edit)
        self.cost += cost
        if edit != "I":
            if fault:
                self.counts[fault] += 1
            if self.before is not None and self.before + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = was[:1]
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.turns = turn, self.turns + 1
        if edit != "D":
            self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


@query("op12_conversations")
def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation of the table, damaged by rule and repaired; those that lost all rows have zeros and an empty audit."""
    conversations = table(spark, folder, "conversations")
    found = summaries(repair(damage(conversations)))
    every = conversations.select("conv_id").distinct()
    joined = join_same(every.withColumn("all", F.lit(1)), found, ["conv_id"], "left")
    zero = [F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
