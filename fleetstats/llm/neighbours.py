"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots and posted in the file of its nearest one; a file holds,
per pivot, the place that each of its vectors has it at.  A query reads the files of its own first pivots, ranks the vectors in them
by the footrule distance of the two orders, and computes exact products for the closest.  How many files it reads, and what
share of each is ranked again, follows from where the true neighbours of a sample of queries stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetstats.llm.batches import arrow_schema
from fleetstats.llm.catalog import query, table
from fleetstats.plans.staging import stage

PIVOTS = 64  # taken by hash
# The index is fitted on so many queries, taken by hash, so that it finds this share of their neighbours.
FIT_QUERIES, RECALL = 128, 0.97
SHARES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.8, 1.0)  # of a file that may be ranked again
VECTORS, QUERIES = 65_536, 16_384  # of a file, and queries that read it at once, in one task; more are split by hash
K = 20


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id`` and ``v`` of the rows that take part, one per id: of repeated ids the least vector.

    Null ids and vectors, vectors that are zero or have a null or non-finite component, and those of
    another length than most are left out.
    """
    v = F.col(embedding).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"))
        .where("vec_id is not null and v is not null")
        .where(finite & F.exists("v", lambda x: x != 0))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )
    rows = stage(rows, "nn-vectors")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].n if sizes else 0))


def _orders(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of each row's pivots, nearest first, ties to the smaller number."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable").astype(np.int16)


def _lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors as directions in one more dimension, in which the largest product is the nearest direction."""
    scaled = v / longest
    rest = np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))
    return np.hstack([scaled, rest[:, None]])


def _directions(v: np.ndarray) -> np.ndarray:
    """Queries as such directions: their length does not matter."""
    return np.hstack([v / np.sqrt((v**2).sum(axis=1, keepdims=True)), np.zeros((len(v), 1))])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


class _File:
    """The vectors posted under one pivot, with the place at which each has every pivot."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("entry")
        self.ids, self.v, near = rows["entry"].to_numpy(), _matrix(rows["v"]), _matrix(rows["near"])
        self.places = np.empty(near.T.shape, np.int16)
        self.places[near.T, np.arange(len(near))] = np.arange(near.shape[1], dtype=np.int16)[:, None]

    def footrule(self, near: np.ndarray) -> np.ndarray:
        """Distance of each vector's order to a query's."""
        own = np.empty(len(near), np.int16)
        own[near] = np.arange(len(near), dtype=np.int16)
        return np.abs(self.places - own[:, None]).sum(axis=0, dtype=np.int32)

    def best(self, q: np.ndarray, k: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and products of the ``k`` with the largest product, ties to the smaller id; of ``some`` or of all."""
        v = self.v if some is None else self.v[some]
        # Row by row in one order, so equal vectors have equal products.
        score = (v * q).sum(axis=1)
        if len(score) > 4 * k:
            close = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        else:
            close = np.arange(len(score))
        close = close[np.argsort(-score[close], kind="stable")[:k]]
        return close if some is None else some[close], score[close]


FOUND = "query_id bigint, entry bigint, score double"
STANDS = FOUND + ", file int, share double"


def _fit(index: DataFrame, sample: list, k: int, least: int, recall: float, sizes: dict[int, int], pivots: int) -> tuple[int, float]:
    """How many files a query reads and what share of each is ranked again: the least work that finds ``recall`` of the
    sample's neighbours.

    Every file is searched for the sample, whole; per query only its ``k`` best come to the driver, each with its file's place
    in the query's order and the share of the file that is as close by footrule.
    """
    near = np.array([r.near for r in sample], np.int16)
    v = np.array([r.v for r in sample], float)
    asked = [r.query_id for r in sample]
    stands = arrow_schema(STANDS)

    def look(rows: pa.Table) -> pa.Table:
        file, number = _File(rows), rows["file"][0].as_py()
        out = []
        for query_id, q, order in zip(asked, v, near):
            best, score = file.best(q, k)
            distance = file.footrule(order)
            at = int(np.flatnonzero(order == number)[0])
            closer = np.searchsorted(np.sort(distance), distance[best], side="right")
            share = np.where(closer <= least, 0.0, closer / len(distance))
            out.append((np.full(len(best), query_id), file.ids[best], score, np.full(len(best), at), share))
        return pa.table({f.name: pa.array(np.concatenate(c), f.type) for f, c in zip(stands, zip(*out))})

    every = index.groupBy("file", "split").applyInArrow(look, STANDS)
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry")
    true = every.where("entry <> query_id").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).collect()
    at, share = np.array([r.file for r in true]), np.array([r.share for r in true])
    # However few a query's files hold, they hold enough to answer it.
    held = np.cumsum(sorted(sizes.get(p, 0) for p in range(pivots)))
    fewest = int(np.searchsorted(held, k + 1)) + 1
    work = []
    for again in SHARES:
        inside = np.sort(at[share <= again])
        if len(true) and len(inside) < recall * len(true):
            continue
        files = int(inside[int(np.ceil(recall * len(true))) - 1]) + 1 if len(true) else pivots
        files = min(pivots, max(files, fewest))
        work.append((files * (0.5 + again), files, again))
    return min(work)[1:]


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = K,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    pivots: int = PIVOTS,
    recall: float = RECALL,
    fit_queries: int = FIT_QUERIES,
) -> DataFrame:
    """The ``k`` vectors of the largest inner product with each query that the index finds.

    ``queries`` is a condition on ``vec_id``.  Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the product
    in double precision; ties go to the smaller id; a query is not its own neighbour.  Rows that take no part are
    those that ``usable`` leaves out.  Other columns are not read.  Without queries or vectors there are no rows.

    Equal vectors are one entry of the index, found once and then listed by their smallest ids, so a vector
    that a third of all rows hold costs as much as any other.  Every vector is indexed.  Clustered vectors need few files;
    where directions are nearly uniform, the neighbours themselves are spread and most files are read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    # The smallest k + 1 ids of each vector are all that a query can list; the rest is cut before the shuffle.
    same = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    members = members.withColumn("entry", F.first("vec_id").over(same))
    members = stage(members, "nn-members")
    entries = members.where("place = 1").select(F.col("vec_id").alias("entry"), "v")
    n, longest = entries.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    asked = rows.where(queries).withColumnRenamed("vec_id", "query_id")
    n_asked = asked.count()
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(pivots).collect()
    posts = _lifted(np.array([r.v for r in sample]), longest)

    def orders(lift) -> Column:
        @F.arrow_udf("array<smallint>")
        def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                flat = _orders(lift(_matrix(batch)), posts).ravel() if len(batch) else np.empty(0, np.int16)
                yield pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * len(posts), flat)

        return listed("v")

    posted = entries.withColumn("near", orders(lambda v: _lifted(v, longest))).withColumn("file", F.get("near", F.lit(0)).cast("int"))
    posted = stage(posted, "nn-index")
    sizes = {r.file: r["count"] for r in posted.groupBy("file").count().collect()}
    splits = F.array(*[F.lit(-(-sizes.get(p, 0) // VECTORS)) for p in range(len(posts))])
    split = F.pmod(F.xxhash64("entry"), F.get(splits, F.col("file"))).cast("int")
    index = posted.withColumn("split", split)
    asking = stage(asked.withColumn("near", orders(_directions)), "nn-queries")
    trial = asking.orderBy(F.xxhash64("query_id"), "query_id").limit(fit_queries).collect()
    least = 2 * (k + 1)
    files, again = _fit(index, trial, k, least, recall, sizes, len(posts))
    parts = -(-n_asked // QUERIES)
    reading = (
        asking.withColumn("part", F.pmod(F.xxhash64("query_id", F.lit("q")), F.lit(parts)).cast("int"))
        .withColumn("file", F.explode(F.slice(F.col("near").cast("array<int>"), 1, files)))
        .withColumn("last", F.get(splits, F.col("file")) - 1).where("last >= 0")
        .withColumn("split", F.explode(F.sequence(F.lit(0), "last"))).drop("last")
    )
    read = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = arrow_schema(FOUND)

    def look(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(asked):
            file = _File(rows)
            most = max(least, int(np.ceil(again * len(file.ids))))
            for query_id, q, near in zip(asked["query_id"].to_numpy(), _matrix(asked["v"]), _matrix(asked["near"])):
                some = None
                if most < len(file.ids):
                    some = np.sort(np.argpartition(file.footrule(near), most - 1)[:most])
                best, score = file.best(q, k + 1, some)
                out.append((np.full(len(best), query_id), file.ids[best], score))
        columns = [np.concatenate(c) for c in zip(*out)] or [np.empty(0)] * 3
        return pa.table({f.name: pa.array(c, f.type) for f, c in zip(found, columns)})

    hits = read.groupBy("file", "split", "part").cogroup(reading.groupBy("file", "split", "part")).applyInArrow(look, FOUND)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry")
    hits = hits.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
    return (
        hits.join(members.select("entry", "vec_id"), "entry")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


@query("op6_neighbours")
def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)
