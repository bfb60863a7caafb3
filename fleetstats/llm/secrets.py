"""Secret scans: stated patterns, and strings in a sensitive place that do not compress.

Patterns find the plain cases.  For the others a string's novelty is measured: its surrounding text is
compressed with and without it by a Zstandard compressor primed with a dictionary of identifiers.  What
the surroundings or the dictionary explain costs few bytes; a key or password costs nearly its length.
Copies of the string itself explain nothing and are taken out of its surroundings.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.llm.catalog import query, table

# Kinds in their order at one place, their patterns, and the least length that counts.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN = 12
# Runs of one class are taken whole, so a least length in the pattern finds the same runs.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

# A candidate is a run of key characters of mixed classes with a word of these shortly before it, or with such a word
# on its own in its context or in the name that it is assigned to, or inside a private key's PEM block.
LEAST_CANDIDATE = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{%d,}" % LEAST_CANDIDATE)
# Letters and a digit, or letters of both cases not only where a word begins.
MIXED = re.compile(r"(?=.*[A-Za-z])(?=.*[0-9])|.*(?:[a-z][A-Z]|[A-Z]{2}[a-z])")
NAMED = re.compile(r".*=(?=[^=])")
WORDS = (
    r"(?:passphrase|password|passwd|pwd|secret|token|credential|bearer|authorization|auth|private|signature|salt"
    r"|(?:api|access|client|session|encryption|signing|ssh|account)[ _-]?(?:key|id)|key)s?"
)
SENSITIVE = re.compile(WORDS + r"\W{0,6}(?:\w+\W{1,4}){0,2}$", re.IGNORECASE | re.ASCII)
# A word on its own: between other characters than letters, or where the case tells words apart.
ALONE = re.compile(rf"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:{WORDS})(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))", re.ASCII)
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END|\Z)", re.DOTALL)
BEFORE, AROUND = 48, 1024  # characters before a candidate that may hold the word; context on each side
# Bytes added per character.  Text and identifiers stay below, hexadecimal digits cost a half and
# base 64 three quarters.
NOVELTY = 0.45
# Identifiers and words that a primed compressor need not pay for.
IDENTIFIERS = (
    "abstract access account action active address admin after agent algorithm alias alpha amount android api app "
    "application argument array asset async attribute auth authorization await backend background base batch before beta "
    "binary block body boolean border bottom branch bucket buffer build bundle button bytes cache callback cancel catalog "
    "category certificate channel char check child class client clone close cluster code collection color column command "
    "comment commit common component config configuration connect connection console const constant constructor container "
    "content context control controller cookie copy core count counter create created credential current cursor custom "
    "data database date debug default define delete dependency deploy description destination detail device dictionary "
    "digest directory disable display document domain double download driver dump dynamic edit element email enable encode "
    "encoding encryption endpoint engine entity entry environment error event example exception execute export expression "
    "extend external factory failed feature fetch field file filter final find flag float folder font footer force form "
    "format frame framework function gateway generate generator global group handle handler hash header height helper "
    "hidden history home host http https identifier image import include index info init input insert install instance "
    "integer interface internal invalid item iterator java javascript join json key keyboard label language latest layout "
    "length level library limit line link list listener load local location lock logger login loop main manager mapping "
    "master match matrix max memory menu merge message metadata method metric migration min mobile model module monitor "
    "name namespace network node notification null number object offset online open operation operator option order output "
    "override package padding page parameter parent parse partition password patch path pattern payload permission "
    "platform plugin point policy pool port position post preview previous primary print priority private process product "
    "production profile project property protected protocol provider proxy public publish python query queue random range "
    "read record redirect reference refresh region register registry release reload remote remove render replace replica "
    "report repository request require reset resource response result retry return role root route router rule runtime "
    "sample scale schedule schema scope screen script search secret section secure security select sender sequence serial "
    "server service session setting setup shared shell signature simple single size socket source staging standard start "
    "state static status stop storage store stream string struct style submit subscription success summary support switch "
    "symbol sync syntax system table target task template temporary terminal test text theme thread threshold time timeout "
    "timestamp title token tools trace transaction transform translate trigger type unique unit update upload url user "
    "username util valid validate value variable vector vendor version video view virtual visible volume warning watch "
    "web widget width window worker workspace wrapper write xml yaml zone 0123456789 1234567890 2020 2021 2022 2023 2024 "
    "2025 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ .com .org .net http:// https:// www. .json .html .py .js"
)

Span = tuple[int, int, int]  # start, place of its kind in KINDS, end

_primed: list = []


def base_spans(text: str) -> list[Span]:
    """Matches of the stated patterns, per kind from the left and not overlapping.

    A match that is too short is passed over whole.
    """
    found: list[Span] = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def marginal_bytes(before: str, candidate: str, after: str) -> int:
    """Bytes that a candidate adds to its compressed surroundings."""
    import zstandard

    if not _primed:
        words = IDENTIFIERS + " " + IDENTIFIERS.title() + " " + IDENTIFIERS.upper()
        content = zstandard.ZstdCompressionDict(words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=9)
        _primed.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False))
    compress = _primed[0].compress
    return len(compress((before + candidate + after).encode())) - len(compress((before + after).encode()))


def surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    """AROUND characters before and after a candidate, with a mark in place of each other copy of it.

    The mark keeps texts around copies from being one longer match, which the candidate would have to pay for breaking.
    Only three or more copies in a row on one line, which are filler, stay and explain each other.
    """
    run, low, high = text[start:end], max(0, start - AROUND), end + AROUND
    # A copy that the edge of the context cuts is taken out as well.
    first, last = max(0, low - len(run) + 1), high + len(run) - 1
    if text.find(run, first, start) < 0 and text.find(run, end, last) < 0:
        return text[low:start], text[end:high]
    word = re.escape(run)
    rows = [m.span() for m in re.finditer(rf"{word}(?:[\x20\t]+{word}){{2,}}", text[first:last])]

    def without(at: int, to: int, a: int, b: int) -> str:
        parts, i = [], text.find(run, a, b)
        while i >= 0:
            if not any(x <= i - first < y for x, y in rows):
                parts.append(text[at : min(i, to)])
                at = max(at, i + len(run))
            i = text.find(run, i + len(run), b)
        return "\0".join([*parts, text[at:to]])

    return without(low, start, first, start), without(end, high, end, last)


def novel_spans(text: str, taken: list[Span], novelty: float = NOVELTY) -> list[Span]:
    """Candidates in a sensitive place whose novelty is enough and that overlap nothing in ``taken``."""
    found: list[Span] = []
    runs = [m for m in CANDIDATE.finditer(text) if MIXED.match(m[0])]
    if not runs:
        return found
    words = [m.span() for m in ALONE.finditer(text)]
    begun = [s for s, _ in words]
    blocks = [m.span(1) for m in PEM.finditer(text)]
    block_starts = [s for s, _ in blocks]
    taken = sorted((s, e) for s, _, e in taken)
    taken_starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for m in runs:
        start, end = m.start(), m.end()
        near, block = bisect_left(begun, start - AROUND), bisect_right(block_starts, start) - 1
        if not (
            (near < len(words) and words[near][1] <= end + AROUND)
            or SENSITIVE.search(text[max(0, start - BEFORE) : start].rpartition("\n")[2])
            or (block >= 0 and end <= blocks[block][1])
        ):
            continue
        name = NAMED.match(m[0])  # the value, if that is long enough on its own
        if name and end - start - name.end() >= LEAST_CANDIDATE:
            start += name.end()
        run = text[start:end]
        if not MIXED.match(run):
            continue
        # Of the spans that begin before this one ends, the one that reaches furthest.
        last = bisect_left(taken_starts, end) - 1
        if last >= 0 and reach[last] > start:
            continue
        before, after = surroundings(text, start, end)
        cost = marginal_bytes(before, run, after)
        if cost >= novelty * len(run):
            found.append((start, 3, end))
    return found


def find_secrets(text: str | Column, novelty: float = NOVELTY) -> Column:
    """The spans of secrets in a text: ``kind``, ``start`` and exclusive ``end`` in code points.

    They are in order of start, then of kind as in ``KINDS``.  A null or empty text has none.  Texts are
    read whole, each on its own.
    """

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            rows = []
            for t in texts:
                text = t.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + novel_spans(text, base, novelty))
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield pa.array(rows, kind)

    return found(text)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", novelty: float = NOVELTY) -> DataFrame:
    """``doc_id`` and its ``secrets``, one row per row of ``docs``, repeated rows and null ids included.

    Other columns are not read, so their names cannot clash.  Nothing is shuffled.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), find_secrets(F.col(text), novelty).alias("secrets"))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced; overlapping spans are replaced as one."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("done")),
        lambda a, s: F.struct(
            F.greatest(a.at, s.end).alias("at"),
            F.when(s.start < a.at, a.done)
            .otherwise(F.concat(a.done, F.substring(text, a.at + 1, s.start - a.at), F.lit(mark)))
            .alias("done"),
        ),
        lambda a: F.concat(a.done, F.substring(text, a.at + 1, F.length(text) - a.at)),
    )
    return F.when(F.size(spans) > 0, step).otherwise(text)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    base = F.filter("secrets", lambda s: s.kind != "novel")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("bigint")

    return scan_secrets(table(spark, folder, "documents")).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("secrets")).alias("spans"),
    )
