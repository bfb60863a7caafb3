"""Streams of several inputs: assembly by tick, as-of alignment, containers with their stats, backfill with live points."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from fleetstats.operators.containers import RUNNING, container_stats, named_containers, with_zeros
from fleetstats.plans.slices import to_micros
from fleetstats.streaming.state import as_state, clocked, fields, keep_state
from fleetstats.streaming.views import watermarked


# Python has the state of a bucket of keys at a time: a call, a timer and a record batch for every key cost milliseconds each.
BUCKETS = 4096


def bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")


class _Processor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass


class _Parts(_Processor):
    """Open ticks of a bucket of keys, with the parts that have come; each is sent when all are there, or when its wait is over."""

    def __init__(self, keys: list[str], parts: list[str], held: StructType, output: list[str], wait_ms: int):
        self.keys, self.parts, self.held, self.row, self.wait_ms = keys, parts, held, Row(*output), wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", self.held)

    def _sent(self, tick: list) -> Row:
        # A part stands in a struct of its own, so that one with a missing value is not a missing part.
        _, _, at, *rest = tick
        key, came = rest[: len(self.keys)], rest[len(self.keys) :]
        return self.row(*key, at, *[c if c is None else c["value"] for c in came], None not in came)

    def _keep(self, ticks: list[list]) -> None:
        self.open.put([tuple(map(as_state, t)) for t in ticks]) if ticks else self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        closed = timerValues.getCurrentWatermarkInMs()
        ticks = {t[0]: list(t) for t in self.open.get()}
        first = 3 + len(self.keys)
        before, rung, touched = len(ticks), min((t[1] for t in ticks.values()), default=None), {}
        for r in rows:
            at, named = r["_at"], [r[k] for k in self.keys]
            id = repr((named, at))
            tick = ticks.get(id)
            if tick is None:
                # A tick without a time waits for no clock.
                ends = 0 if at is None else at // 1000 + self.wait_ms
                tick = ticks[id] = [id, max(ends, closed + 1), at, *named, *[None] * len(self.parts)]
            touched[id] = tick
            for i, p in enumerate(self.parts, first):
                if tick[i] is None:
                    tick[i] = r[p]
        sent = [i for i, t in touched.items() if None not in t[first:]]
        known = set(list(ticks)[:before])
        for id in sent:
            yield self._sent(ticks.pop(id))
        if known.isdisjoint(touched):
            fresh = [tuple(map(as_state, t)) for i, t in touched.items() if i in ticks]
            if fresh:
                self.open.appendList(fresh)
        else:
            self._keep([*ticks.values()])
        ends = min((t[1] for t in ticks.values()), default=None)
        if ends is not None and (rung is None or ends < rung):
            self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        over = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        ticks = [list(t) for t in self.open.get()]
        rest = [t for t in ticks if t[1] > over]
        for t in ticks:
            if t[1] <= over:
                yield self._sent(t)
        if len(rest) < len(ticks):
            self._keep(rest)
        if rest:
            self.handle.registerTimer(min(t[1] for t in rest))


def stream_assemble(
    parts: Mapping[str, DataFrame], keys: Sequence[str] = ("host",), ts: str = "ts", wait: str = "30 seconds", buckets: int = BUCKETS
) -> DataFrame:
    """One row per tick (``keys`` and ``ts``) from collectors that arrive as streams of their own.

    ``parts`` maps a column to a stream with one row per tick, a list as an array; what it holds beside the keys becomes a struct, or the
    value itself if it is one column.  A tick is sent when all of its parts have come, or once the newest time of any stream is ``wait``
    past it, with NULL for those that are missing; ``complete`` tells which.  Of a repeated part the first counts.  A part that
    comes when its tick has been sent starts the tick anew and is sent after another wait, so nothing is lost.

    State is held per tick and only while the tick is open.  The open ticks of a bucket of keys are read and written together; a task
    holds those of one bucket at a time, and ``buckets`` stays as it is for the life of a checkpoint.
    """
    def stacked(name: str, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in (*keys, ts)]
        value = F.col(rest[0]) if len(rest) == 1 else F.struct(*rest)
        return df.select(*keys, F.col(ts).cast("timestamp").alias(ts), F.struct(value.alias("value")).alias(name))

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [stacked(n, df) for n, df in parts.items()])
    keep_state(rows.sparkSession)
    keys, names = list(keys), list(parts)
    timed = clocked(rows, ts, "0 seconds", "_at").select(bucket([*keys, "_at"], buckets), *keys, "_at", *names)
    held = StructType(
        [StructField("_id", StringType()), StructField("_ends", LongType()), *[timed.schema[n] for n in ("_at", *keys, *names)]]
    )
    output = StructType(
        [*[timed.schema[n] for n in (*keys, "_at")], *[StructField(n, timed.schema[n].dataType["value"].dataType) for n in names]]
        + [StructField("complete", BooleanType())]
    )
    ticks = _Parts(keys, names, held, output.names, to_micros(wait) // 1000)
    sent = timed.groupBy("_bucket").transformWithState(ticks, output, "append", "EventTime")
    return sent.select(*keys, F.timestamp_micros("_at").alias(ts), *names, "complete")


class _AsOf(_Processor):
    """A bucket of keys: rows that the watermark has not passed, of both sides, and each key's newest right row that it has.

    A key's rows are taken in the order of their times once no earlier one can come.
    """

    def __init__(self, keys: list[str], waiting: StructType, newest: StructType, output: list[str]):
        self.keys, self.waiting_type, self.newest_type, self.row = keys, waiting, newest, Row(*output)
        self.named = Row(*waiting.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", self.waiting_type)
        self.newest = handle.getListState("newest", self.newest_type)

    def _found(self, r, known, late: bool) -> Row:
        values = [None] * len(self.newest_type["value"].dataType) if known is None else fields(known[1])
        return self.row(*[r[k] for k in self.keys], *fields(r["left"]), *values, late)

    def _key(self, r: Row) -> str:
        return repr([r[k] for k in self.keys])

    def _entry(self, key: str, r: Row) -> tuple:
        return key, *[as_state(r[n]) for n in self.waiting_type.names[1:]]

    @staticmethod
    def _order(r) -> list:
        """By time, the right side first, then by its sequence; missing values first."""
        return [r["at"], r["side"], *[(x is not None, x) if x is not None else (False,) for x in fields(r["seq"] or ())]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        closed = timerValues.getCurrentWatermarkInMs()
        fresh, behind = [], []
        for r in rows:
            if r["at"] is None:
                if r["side"]:
                    yield self._found(r, None, False)
            else:
                (fresh if r["at"] // 1000 >= closed else behind).append((self._key(r), r))
        if behind:
            yield from self._closed(closed, behind)
        if fresh:
            self.waiting.appendList([self._entry(*r) for r in fresh])
            self.handle.registerTimer(min(r["at"] for _, r in fresh) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._closed(timerValues.getCurrentWatermarkInMs(), [])

    def _closed(self, closed: int, behind: list[tuple[str, Row]]) -> Iterator[Row]:
        """Go through what waited for the watermark together with what comes behind it, in the order of times."""
        waiting = [self.named(*r) for r in self.waiting.get()]
        due: dict[str, list] = {}
        for r in waiting:
            if r["at"] // 1000 < closed:
                due.setdefault(r["_key"], []).append((self._order(r), False, r))
        for key, r in behind:
            due.setdefault(key, []).append((self._order(r), True, r))
        if not due:
            return
        newest = {key: (at, value) for key, at, value in self.newest.get()}
        before = dict(newest)
        for key, rows in due.items():
            known = newest.get(key)
            for _, late, r in sorted(rows, key=lambda d: d[0]):
                # What was newest before may be newer than a late row.
                usable = known is None or known[0] <= r["at"]
                if r["side"]:
                    yield self._found(r, known if usable else None, late)
                elif usable:
                    known = (r["at"], r["right"])
            if known is not None:
                newest[key] = known
        changed = [k for k, known in newest.items() if known is not before.get(k)]
        if changed:
            entries = [(k, newest[k][0], as_state(newest[k][1])) for k in (changed if before.keys().isdisjoint(changed) else newest)]
            (self.newest.appendList if before.keys().isdisjoint(changed) else self.newest.put)(entries)
        rest = [r for r in waiting if r["at"] // 1000 >= closed]
        if len(rest) == len(waiting):
            return
        if rest:
            self.waiting.put([self._entry(r["_key"], r) for r in rest])
            self.handle.registerTimer(min(r["at"] for r in rest) // 1000 + 1)
        else:
            self.waiting.clear()


def stream_as_of(
    left: DataFrame, right: DataFrame, values: Sequence[str], keys: Sequence[str] = ("host",), ts: str = "ts",
    right_seq: Sequence[str] = (), late: str = "10 minutes", buckets: int = BUCKETS,
) -> DataFrame:
    """``operators.asof.as_of`` of two streams: each left row with ``values`` of the newest right row of its key not after it.

    Rows wait until the watermark, ``late`` behind the newest time of either stream, has passed them, so files may come out of
    order within that.  A left row that comes later still is sent at once with what is known by its time, and ``late`` true;
    a later right row counts from then on.  A left row without a time gets NULLs, a right row without one matches nothing.

    State per key is the newest right row and the rows of the last ``late``.  That of a bucket of keys is read and written together; a
    task holds one bucket at a time, and ``buckets`` stays as it is for the life of a checkpoint.
    """
    keys, values, right_seq = list(keys), list(values), list(right_seq)
    kept = [c for c in left.columns if c not in keys]
    # Zoned times, as watermarks and state have them.
    shaped = left.withColumn(ts, F.col(ts).cast("timestamp"))
    seq = F.struct(*right_seq) if right_seq else F.lit(None).cast("struct<none:int>")
    asked = shaped.select(*keys, F.col(ts).alias("_ts"), F.lit(1).alias("side"), F.struct(*kept).alias("left"))
    known = right.select(
        *keys, F.col(ts).cast("timestamp").alias("_ts"), F.lit(0).alias("side"), seq.alias("seq"), F.struct(*values).alias("right")
    )
    both = asked.unionByName(known, allowMissingColumns=True)
    keep_state(both.sparkSession)
    timed = clocked(both, "_ts", late, "at").select(bucket(keys, buckets), *keys, "at", "side", "seq", "left", "right")
    name = StructField("_key", StringType())
    waiting = StructType([name, *[timed.schema[n] for n in (*keys, "at", "side", "seq", "left", "right")]])
    newest = StructType([name, StructField("at", LongType()), StructField("value", timed.schema["right"].dataType)])
    taken = [c for c in values if c in left.columns]
    if taken:
        raise ValueError(f"both sides have {taken}")
    output = StructType(
        [*[timed.schema[k] for k in keys], *timed.schema["left"].dataType.fields, *timed.schema["right"].dataType.fields]
        + [StructField("late", BooleanType())]
    )
    return timed.groupBy("_bucket").transformWithState(_AsOf(keys, waiting, newest, output.names), output, "append", "EventTime")


def stream_containers(
    listed: DataFrame, stats: DataFrame, late: str = "1 minute", apart: str = "0 seconds", baseline: str = "embedded"
) -> DataFrame:
    """``operators.containers.containers`` of two streams: container lists with the stats documents that belong to them.

    A running container is joined to the stats document of its id within ``apart`` of its time, whichever comes first; rows wait
    for each other until the watermark, ``late`` behind the newest time, has passed them, and then a container without stats is
    sent with zeros.  Containers that do not run need no stats and are sent at once.  Of stats from the previous
    poll (``baseline='poll'``) only batch tables can tell.
    """
    if baseline != "embedded":
        raise ValueError("a stream takes stats documents with their own baseline")
    metrics = ("cpu_pct", "mem_usage", "mem_limit")
    named = watermarked(named_containers(listed), "ts", late)
    measured = watermarked(container_stats(stats), "ts", late)
    measured = measured.select(*[F.col(c).alias(f"_{c}") for c in ("host", "id", "ts")], *metrics)
    runs = F.coalesce(F.col("state") == RUNNING, F.lit(False))
    span = F.expr(f"INTERVAL {to_micros(apart)} MICROSECONDS")
    near = (F.col("_ts") >= F.col("ts") - span) & (F.col("_ts") <= F.col("ts") + span)
    same = F.col("host").eqNullSafe(F.col("_host")) & F.col("id").eqNullSafe(F.col("_id")) & near
    joined = named.where(runs).join(measured, same, "left").drop("_host", "_id", "_ts")
    still = named.where(~runs).withColumns({m: F.lit(None).cast(measured.schema[m].dataType) for m in metrics})
    return with_zeros(joined.unionByName(still), metrics)


def stream_backfill(
    backfill: DataFrame, live: DataFrame, keys: Sequence[str] = ("host",), ts: str = "ts", seq: Sequence[str] = (), late: str = "10 minutes"
) -> DataFrame:
    """Replayed history and live points of two streams, one point per key and time, the live one where both have it.

    ``append`` mode sends a point once the watermark, ``late`` behind the newest time, has passed it; until then the other stream may
    still bring it.  Keeping what comes first would be a coin toss between the two, so the better of them is
    aggregated: state is one point per key and open time, and tasks combine before the shuffle.  ``operators.series.tail`` of the landed
    points is ``backfill_union`` with ``dedupe``.
    """
    both = backfill.withColumn("_live", F.lit(0)).unionByName(live.withColumn("_live", F.lit(1)))
    timed = watermarked(both, ts, late)
    rest = [c for c in backfill.columns if c not in (*keys, ts)]
    best: Column = F.max_by(F.struct(*rest), F.struct("_live", *seq)).alias("_point")
    return timed.groupBy(*keys, ts).agg(best).select(*keys, ts, "_point.*").select(*backfill.columns)
