"""Hard negatives, with scores bounded along spanning trees of anchors.

Anchors that are close stand in one tree.  A row's score at an anchor lies within the tree edge's length times the row's
norm of its score at the parent, so an anchor computes exact scores only where that interval meets the window it
looks for.  Anchors in blocks meet rows in blocks: first for each anchor's positives, then for the negatives in
the windows these open.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetstats.llm.batches import arrow_schema
from fleetstats.llm.catalog import query, table
from fleetstats.plans.staging import stage

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative's score, in hundredths of the positive's
TREE = 1024  # anchors of a tree, about
TREES = 16  # of a block of anchors
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 4096, 65536, 64  # rows of a block: a BLOCKS-th of all, within these bounds
STRIP = 4096  # rows that go through a tree at once
MOST_CELLS = 1024  # pivots that part the anchors, taken by hash
EXACT = 2.0**53  # doubles hold integers up to here


def quantised(vectors: DataFrame, vec_id: str, embedding: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, v, norm) of the rows that take part; of repeated ids the row of the least label and vector.

    ``v`` holds ``floor(scale * x)``.  Rows with a null id, label or vector, with null or non-finite components, or whose
    product with itself is beyond a bigint, take no part.
    """
    v = F.transform(F.col(embedding).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), v.alias("x"))
    rows = rows.where("vec_id is not null and label is not null and x is not null")
    rows = rows.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**31)))
    rows = rows.withColumn("v", F.transform("x", lambda x: F.floor(x))).drop("x")
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    rows = rows.where(F.col("norm") < 2.0**31)
    least = F.min(F.struct("label", "v", "norm")).alias("row")
    return rows.groupBy("vec_id").agg(least).select("vec_id", "row.label", "row.v", "row.norm", F.size("row.v").alias("dim"))


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``v`` in depth-first order of a minimum spanning tree; each one's parent (a place in that order, -1 at the root) and edge."""
    n = len(v)
    square = (v * v).sum(axis=1)
    near, parent, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    children: list[list[int]] = [[] for _ in range(n)]
    now = 0
    for _ in range(n):
        left[now] = False
        if parent[now] >= 0:
            children[parent[now]].append(now)
        far = np.maximum(0.0, square + square[now] - 2 * (v @ v[now]))
        closer = left & (far < near)
        near[closer], parent[closer] = far[closer], now
        if left.any():
            now = int(np.where(left, near, np.inf).argmin())
    order, stack = [], [0]
    while stack:
        order.append(stack.pop())
        stack.extend(reversed(children[order[-1]]))
    order = np.array(order)
    place = np.empty(n, int)
    place[order] = np.arange(n)
    up = np.where(parent[order] >= 0, place[parent[order]], -1)
    edge = np.where(up >= 0, np.sqrt(((v[order] - v[order][up]) ** 2).sum(axis=1)), 0.0)
    return order, up, edge


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten().to_numpy(zero_copy_only=False) if len(column) else np.empty(0)
    return flat.reshape(len(column), -1)


class _Strip:
    """Some rows, and their scores at one anchor after another: exact ones where asked for, else bounds."""

    def __init__(self, v: np.ndarray, norms: np.ndarray, longest: float):
        # Products within EXACT are exact in doubles, whatever their order; greater ones are taken in integers.
        self.exact = float if longest * (norms.max() if len(norms) else 0.0) < EXACT else np.int64
        self.v, self.norms = v.astype(self.exact), norms
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bounds(self, parent: int, edge: float, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each row at an anchor, from those at its parent."""
        if parent < 0:
            score = (self.v @ anchor.astype(self.exact)).astype(float)
            return score, score.copy()
        low, high = self.open[parent]
        # Distances and norms are rounded; a unit more than their error keeps the bounds true.
        reach = edge * self.norms * (1 + 1e-9) + 1
        return low - reach, high + reach

    def rescore(self, low: np.ndarray, high: np.ndarray, which: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact scores of the rows ``which``; their bounds close on them."""
        part = self.v if len(which) == len(self.v) else self.v[which]
        score = part @ anchor.astype(self.exact)
        low[which] = high[which] = score
        return score.astype(np.int64)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _walk(anchors: pa.Table, rows: pa.Table, visit: Callable) -> dict[str, list]:
    """Take strips of ``rows`` through the trees of ``anchors``; ``visit`` looks at one anchor and returns what it found."""
    out: dict[str, list] = {}
    if not len(anchors) or not len(rows):
        return out
    anchors = anchors.sort_by([("tree", "ascending"), ("place", "ascending")])
    rows = rows.sort_by([("label", "ascending"), ("vec_id", "ascending")])
    tree, parent, edge = (anchors[n].to_numpy().copy() for n in ("tree", "parent", "edge"))
    wanted = anchors.drop_columns(["v"]).to_pylist()
    points, longest = _matrix(anchors["v"]), float(anchors["norm"].to_numpy().max())
    ids, labels, norms, v = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), rows["norm"].to_numpy(), _matrix(rows["v"])
    starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    last_child = np.full(len(wanted), -1)
    for start, end in zip(starts, [*starts[1:], len(wanted)]):
        for i in range(start, end):
            if parent[i] >= 0:
                parent[i] += start
                last_child[parent[i]] = i
    for at in range(0, len(ids), STRIP):
        to = slice(at, at + STRIP)
        strip = _Strip(v[to], norms[to], longest)
        for i, anchor in enumerate(wanted):
            low, high = strip.bounds(parent[i], edge[i], points[i])
            for name, values in visit(strip, anchor, points[i], ids[to], labels[to], low, high).items():
                out.setdefault(name, []).extend(values)
            # Bounds stay only until the last child has used them.
            if last_child[i] >= 0:
                strip.open[i] = (low, high)
            if parent[i] >= 0 and last_child[parent[i]] == i:
                del strip.open[parent[i]]
    return out


def _positives(k: int) -> Callable:
    """The best rows of the anchor's own label: exact scores where the greatest one possible reaches the k-th least."""

    def visit(strip, anchor, point, ids, labels, low, high):
        own = np.arange(*np.searchsorted(labels, [anchor["label"], anchor["label"] + 1]))
        own = own[ids[own] != anchor["anchor_id"]]
        if not len(own):
            return {}
        if len(own) > k:
            sure = np.partition(low[own], len(own) - k)[len(own) - k]
            own = own[high[own] >= sure]
        score = strip.rescore(low, high, own, point)
        best = _top(score, ids[own], k)
        return {"anchor_id": [anchor["anchor_id"]] * len(best), "positive_id": ids[own][best].tolist(), "positive_score": score[best].tolist()}

    return visit


def _negatives(k: int) -> Callable:
    """The best rows of other labels in each positive's window: exact scores where the bounds meet a window."""

    def visit(strip, anchor, point, ids, labels, low, high):
        windows = [w for w in anchor["windows"] if w["least"] <= w["most"]]
        found = {n: [] for n in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")}
        if not windows:
            return found
        least, most = min(w["least"] for w in windows), max(w["most"] for w in windows)
        meet = (high >= least) & (low <= most) & (labels != anchor["label"])
        meet = np.flatnonzero(meet)
        if not len(meet):
            return found
        score = strip.rescore(low, high, meet, point)
        order = np.lexsort((ids[meet], -score))
        falling, named = -score[order], ids[meet][order]
        for w in windows:
            start = int(np.searchsorted(falling, -w["most"]))
            end = min(start + k, int(np.searchsorted(falling, -w["least"], side="right")))
            found["negative_id"] += named[start:end].tolist()
            found["negative_score"] += (-falling[start:end]).tolist()
            n = max(0, end - start)
            found["anchor_id"] += [anchor["anchor_id"]] * n
            found["positive_id"] += [w["positive_id"]] * n
            found["positive_score"] += [w["positive_score"]] * n
        return found

    return visit


def _meet(anchors: DataFrame, rows: DataFrame, visit: Callable, schema: str) -> DataFrame:
    """Every block of anchors with every block of rows of as many components."""

    def look(some: pa.Table, those: pa.Table) -> pa.Table:
        found = _walk(some, those, visit)
        return pa.table({f.name: pa.array(found.get(f.name, []), f.type) for f in arrow})

    arrow = arrow_schema(schema)
    return anchors.groupBy("dim", "part", "block").cogroup(rows.groupBy("dim", "part", "block")).applyInArrow(look, schema)


def _spread(df: DataFrame, name: str, n: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def planted(anchors: DataFrame, tree: int = TREE, trees: int = TREES) -> tuple[DataFrame, int]:
    """Anchors in trees of about ``tree`` close ones, ``trees`` of which make a block (``part``); and the number of blocks.

    Anchors are parted by their nearest pivot, and a pivot's by hash if they are too many for one tree.
    """
    n = anchors.count()
    cells = max(1, min(MOST_CELLS, -(-n // tree)))
    pivots = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells).select("v").collect()
    points = [np.array(p.v, float) for p in pivots]

    @F.arrow_udf("int")
    def cell(column: pa.Array) -> pa.Array:
        near = []
        for v in column.to_pylist():
            v = np.array(v, float)
            far = [((v - p) ** 2).sum() if len(p) == len(v) else np.inf for p in points]
            near.append(int(np.argmin(far)))
        return pa.array(near, pa.int32())

    celled = stage(anchors.withColumn("cell", cell("v")), "negatives-anchors")
    counts = dict(celled.groupBy("cell").count().collect())
    firsts, splits, total = [], [], 0
    for c in range(cells):
        firsts.append(total)
        splits.append(max(1, -(-counts.get(c, 0) // tree)))
        total += splits[-1]
    at = F.col("cell") + 1
    number = F.element_at(F.array(*map(F.lit, firsts)), at) + F.pmod(F.xxhash64("vec_id"), F.element_at(F.array(*map(F.lit, splits)), at))
    numbered = celled.withColumn("tree", number.cast("int"))

    def grow(some: pa.Table) -> pa.Table:
        some = some.sort_by("vec_id")
        order, parent, edge = spanning_tree(_matrix(some["v"]).astype(float))
        some = some.take(pa.array(order))
        columns = {n: some[n] for n in ("dim", "tree", "vec_id", "label", "v", "norm")}
        return pa.table(columns | {"place": pa.array(np.arange(len(order)), pa.int32()), "parent": pa.array(parent, pa.int32()), "edge": edge}).rename_columns(
            ["dim", "tree", "anchor_id", "label", "v", "norm", "place", "parent", "edge"]
        )

    schema = "dim int, tree int, anchor_id bigint, label bigint, v array<bigint>, norm double, place int, parent int, edge double"
    grown = stage(numbered.groupBy("dim", "tree").applyInArrow(grow, schema), "negatives-trees")
    return grown.withColumn("part", F.floor(F.col("tree") / trees).cast("int")), -(-total // trees)


def mine(
    vectors: DataFrame, anchors: Column, label: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding",
    scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    tree: int = TREE, trees: int = TREES, block: int | None = None,
) -> DataFrame:
    """For each anchor and each of its positives, the hardest rows of other labels that are not too close.

    ``anchors`` is a condition on ``vec_id``; ``label`` an expression over the table, its ``label`` by default.  A score is the product of
    the vectors ``floor(scale * x)``.  Positives are the ``positives`` best other rows of the anchor's label; negatives the ``negatives``
    best rows of other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``; all, where
    there are fewer.  Ties go to the smaller id.  Returns ``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id``,
    ``positive_score``, ``negative_score``.  Anchors without positives, and positives without negatives, have no rows; nor has an empty
    table.  Rows that take no part are those that ``quantised`` leaves out; vectors of different lengths do not meet.

    Results are exact: bounds only spare work.  Every block of anchors meets every block of rows, so rows are moved once per
    ``tree * trees`` anchors, and anchors once per block of rows.
    """
    rows = stage(quantised(vectors, vec_id, embedding, F.col("label") if label is None else label, scale), "negatives-rows")
    found = "anchor_id bigint, positive_id bigint, positive_score bigint"
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    asked = rows.where(anchors)
    if asked.isEmpty():
        return vectors.sparkSession.createDataFrame([], result)
    grown, parts = planted(asked, tree, trees)
    n = rows.count()
    size = block or min(MOST_BLOCK, max(LEAST_BLOCK, n // BLOCKS))
    blocks = -(-n // size)
    candidates = _spread(rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "part", parts)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = _meet(_spread(grown, "block", blocks), candidates, _positives(positives), found)
    near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    # In integers, and without products that a bigint cannot hold: the least and the greatest score of the window.
    rest = "pmod(positive_score, 100)"
    hundreds = f"(positive_score - {rest}) div 100"
    least = F.expr(f"{low} * ({hundreds}) + ({low} * {rest} + 99) div 100")
    most = F.expr(f"{high} * ({hundreds}) + ({high} * {rest}) div 100")
    window = F.struct("positive_id", "positive_score", least.alias("least"), most.alias("most"))
    windows = stage(near.groupBy("anchor_id").agg(F.collect_list(window).alias("windows")), "negatives-windows")
    opened = grown.join(windows, "anchor_id", "left").withColumn("windows", F.coalesce("windows", F.array().cast(windows.schema["windows"].dataType)))
    hard = _meet(_spread(opened, "block", blocks), candidates, _negatives(negatives), found + ", negative_id bigint, negative_score bigint")
    ranked = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP13_SQL = f"""
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
    case when len(a.v) = len(b.v) then list_inner_product(a.v, b.v)::bigint end as score
  from r a join r b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s
  where same and score is not null
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES}
)
select anchor_id, positive_id,
  (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::integer as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= {NEGATIVES}
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Some labels are false on purpose: those of ids divisible by 7 are moved on by one."""
    own = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (own + 1) % 10).otherwise(own)
    return mine(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, label)
