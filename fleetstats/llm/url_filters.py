"""URL filters: rules of a host and a path prefix, met by a sort-merge range join.

A rule fits its host and all subdomains, where the url's path starts with the rule's.  Hosts are written with their
labels reversed and joined to the path, so that a rule is a prefix of the keys it fits and thus an interval of them.  Keys
of urls and of rules are sorted together; a sweep keeps the stack of rules whose intervals are open, one
inside the other, and its top is the longest that fits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.llm.catalog import query, table
from fleetstats.llm.names import unused
from fleetstats.plans.staging import stage

ALLOW = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
KEYS_PER_PART = 1_000_000  # of the sweep, more if that made over MOST_PARTS parts
MOST_PARTS = 4096
SAMPLE = 20_000  # keys, taken by hash, that bound the parts
BOUND_CHARS = 256  # of a key, by which parts are bounded
LEAST_SALT = -(2**63)


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The key: labels of the host in reverse, a slash, the path.  Hosts hold no slash, so the first one ends the host."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("/"), path)


def _usable(rules: DataFrame) -> DataFrame:
    """One row per host and path; of different verdicts the greatest (block before allow)."""
    host = F.translate("host", UPPER, LOWER)
    return (
        rules.select(host.alias("host"), "path", "verdict")
        .where("host is not null and path is not null and verdict is not null")
        .where(~F.col("host").rlike("[/?#]"))
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part and key, a rule before the urls of an equal key."""
    part, stack = None, []
    for batch in batches:
        found = {name: [] for name in ("near_host", "near_path", "rule_host", "rule_path", "verdict")}
        columns = [batch.column(name).to_pylist() for name in ("part", "key", "near_host", "near_path", "rule_host", "rule_path", "verdict")]
        for at, key, near_host, near_path, *rule in zip(*columns):
            if at != part:
                part, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if near_host is None:
                stack.append((key, rule))
            elif stack:
                for name, value in zip(found, (near_host, near_path, *stack[-1][1])):
                    found[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in found.values()], list(found))


def _parts(bounds: list[tuple[str, int]]) -> Column:
    """The parts a row belongs to: a url's one, or all that a rule's interval meets."""
    heads = [b[0] for b in bounds]

    @F.arrow_udf("array<int>")
    def listed(keys: pa.Array, salts: pa.Array) -> pa.Array:
        out = []
        for key, salt in zip(keys.to_pylist(), salts.to_pylist()):
            if salt is not None:
                out.append([bisect_right(bounds, (key, salt))])
            else:
                first = bisect_right(bounds, (key, LEAST_SALT))
                last = bisect_right(heads, key, key=lambda head, n=len(key): head[:n])
                out.append(list(range(first, max(first, last) + 1)))
        return pa.array(out, pa.list_(pa.int32()))

    return listed(F.substring("key", 1, BOUND_CHARS), "salt")


def longest_rules(classes: DataFrame, rules: DataFrame, keys_per_part: int = KEYS_PER_PART) -> DataFrame:
    """For each row (near_host, near_path) that a rule fits, the longest such rule and its verdict.

    Every suffix of a host is looked up with the path.  Keys are dealt to parts by quantiles of a hash sample, with a
    hash of the row behind the key, so that a key many rows share is parted as well.  A rule goes to each part that its
    interval meets: those open at a bound are prefixes of that bound, so there are few.
    """
    suffixes = F.expr(r"transform(sequence(1, size(split(near_host, '\\.'))), n -> substring_index(near_host, '.', -n))")
    none = F.lit(None).cast("string")
    asked = classes.withColumn("suffix", F.explode(suffixes)).select(
        canonical(F.col("suffix"), F.col("near_path")).alias("key"), F.xxhash64("near_host", "near_path").alias("salt"),
        "near_host", "near_path", none.alias("rule_host"), none.alias("rule_path"), none.alias("verdict"),
    )
    given = rules.select(
        canonical(F.col("host"), F.col("path")).alias("key"), F.lit(None).cast("bigint").alias("salt"),
        none.alias("near_host"), none.alias("near_path"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict",
    )
    n = asked.count()
    parts = max(1, min(MOST_PARTS, -(-n // keys_per_part)))
    bounds = []
    if parts > 1:
        sample = asked.select(F.substring("key", 1, BOUND_CHARS).alias("head"), "salt")
        taken = sorted(tuple(r) for r in sample.orderBy(F.xxhash64("head", "salt"), "head", "salt").limit(SAMPLE).collect())
        bounds = sorted({taken[len(taken) * i // parts] for i in range(1, parts)})
    rows = asked.unionByName(given).withColumn("part", F.explode(_parts(bounds)))
    swept = rows.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "key", F.col("near_host").asc_nulls_first())
    found = swept.drop("salt").mapInArrow(
        _sweep, "near_host string, near_path string, rule_host string, rule_path string, verdict string"
    )
    size = F.length("rule_host") + F.length("rule_path")
    best = F.max(F.struct(size.alias("size"), F.length("rule_host").alias("of_host"), F.concat("rule_host", "rule_path").alias("rule"), "verdict"))
    return found.groupBy("near_host", "near_path").agg(best.alias("best")).select("near_host", "near_path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW, keys_per_part: int = KEYS_PER_PART) -> DataFrame:
    """The rows of ``pages`` with ``host``, ``path``, ``rule`` (host and path of the one that decides, else null) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``.  The longest rule that fits decides, of equally long ones that of the
    longer host, of equal ones the greater verdict; without any the verdict is ``default``.  Rules with a null,
    or with a slash, question or number sign in the host, fit nothing.  A null url, or one without ``://``, has an
    empty host and path, and is judged by rules for the empty host.  Every row of ``pages`` is returned once, repeated ones too; of
    its columns those named like a new one are replaced.  Empty tables give no rows, or ``default`` everywhere.

    Only what a rule can see of a url travels: as many labels as the longest rule's host has and as many characters
    as the longest rule's path has.  Urls alike in these are looked up once.
    """
    rules = stage(_usable(rules), "url-rules")
    most = rules.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.length("path"))).first()
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    names = unused([*kept, "host", "path", "rule", "verdict"], "near_host", "near_path", "their_host", "their_path")
    near_host, near_path, their_host, their_path = names
    seen = pages.select(*[pages[c] for c in kept], host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    if most[0] is None:
        return seen.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    seen = seen.withColumns({near_host: F.substring_index("host", ".", -most[0]), near_path: F.substring("path", 1, most[1])})
    classes = stage(seen.select(F.col(near_host).alias("near_host"), F.col(near_path).alias("near_path")).distinct(), "url-classes")
    best = stage(longest_rules(classes, rules, keys_per_part), "url-verdicts").toDF(their_host, their_path, "rule", "verdict")
    judged = seen.join(best, (F.col(near_host) == F.col(their_host)) & (F.col(near_path) == F.col(their_path)), "left")
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default))).drop(*names)


# The query's rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

OP11_SQL = rf"""
with urls as (
  select page_id, coalesce(url, '') as url from pages
), parts as (
  select page_id,
    translate(regexp_extract(url, '{URL}', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(url, '{URL}', 2) as path
  from urls
), rules(rule_host, rule_path, verdict) as (
  values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}
), fit as (
  select h.host, h.path, rule_host || rule_path as rule, verdict,
    row_number() over (partition by h.host, h.path order by length(rule_host || rule_path) desc, length(rule_host) desc) as place
  from (select distinct host, path from parts) h
  join rules on (h.host = rule_host or ends_with(h.host, '.' || rule_host)) and starts_with(h.path, rule_path)
)
select page_id, parts.host, parts.path, rule, coalesce(verdict, '{ALLOW}') as verdict
from parts left join fit on parts.host = fit.host and parts.path = fit.path and place = 1
"""


@query("op11_url_filters", OP11_SQL)
def op11_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")
