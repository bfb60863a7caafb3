"""Counter rates of a stream, with the newest sample of each key as its state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from fleetstats.plans.slices import to_micros
from fleetstats.streaming.state import clocked, keep_state

_WHOLE, _FLOATING = ("tinyint", "smallint", "int", "bigint"), ("float", "double")


class _Rates(StatefulProcessor):
    """Rates of one key's samples against the sample before; the newest one stays.

    A key has one timer.  When it fires too early, because the key has been heard since, it is set anew, so that a
    sample costs one read and one write of the state and no change of timers.
    """

    def __init__(self, counters: list[str], order: list[str], kept: list[str], output: list[str], held: StructType, idle_ms: int):
        self.counters, self.order, self.kept, self.held, self.idle_ms = counters, order, kept, held, idle_ms
        self.row = Row(*output)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.held)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.newest.get() if self.newest.exists() else None
        at, before = (known[0], list(known[1:])) if known else (None, None)
        began = at
        # Missing values first, as windows order them.
        ordered = sorted(rows, key=lambda r: [(r[c] is not None, r[c]) if r[c] is not None else (False,) for c in self.order])
        for r in ordered:
            rates, reset = [0.0] * len(self.counters), False
            # Later samples of one batch may share a time; those not after the state's newest are late.
            late = r["_at"] is None or (began is not None and r["_at"] <= began)
            if not late:
                now = [r[c] for c in self.counters]
                if before is not None:
                    seconds = (r["_at"] - at) / 1e6 if r["_at"] > at else 1.0
                    for i, (a, b) in enumerate(zip(before, now)):
                        if a is None:
                            continue
                        if b is None:
                            rates[i] = None
                        elif b < a:
                            reset = True
                        else:
                            rates[i] = float(b - a) / seconds
                at, before = r["_at"], now
            yield self.row(*[r[c] for c in self.kept], *rates, reset, late)
        if at is not None and at != began:
            self.newest.update((at, *before))
        if known is None and at is not None:
            self.handle.registerTimer(max(at // 1000 + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.newest.exists():
            ends = self.newest.get()[0] // 1000 + self.idle_ms
            if ends <= timerValues.getCurrentWatermarkInMs():
                self.newest.clear()
            else:
                self.handle.registerTimer(ends)
        return iter(())


def stream_counter_rate(
    df: DataFrame,
    counters: Sequence[str] = ("bytes_sent", "bytes_recv"),
    keys: Sequence[str] = ("host", "name"),
    ts: str = "ts",
    seq: Sequence[str] = (),
    forget: str = "1 hour",
) -> DataFrame:
    """``operators.rates.counter_rate`` on a stream, with ``elapsed='key'``.

    State is the newest sample of each key, read and written only when the key has samples.  A timer on event time drops it
    when the key has been silent for ``forget``; a key that returns later starts at rate 0.  Within a micro-batch samples are
    taken in time order.  A sample not after the state's is kept with rate 0 and ``late`` true and leaves the state
    alone, however late it is: the watermark drives timers and drops nothing.  A sample without a time is late.
    Whole counters are exact, fractional ones are doubles; counters of other types are refused.

    Keys are independent of each other, so the state grows with the keys that are alive and is spread by them.
    The stream's state is kept in RocksDB (``keep_state``).
    """
    counters, keys, seq = list(counters), list(keys), list(seq)
    kept = list(dict.fromkeys([*keys, ts, *seq, *counters]))
    keep_state(df.sparkSession)
    timed = clocked(df.select(*kept), ts, "0 seconds", "_at")
    kinds = {c: timed.schema[c].dataType.simpleString() for c in counters}
    if not all(k in (*_WHOLE, *_FLOATING) for k in kinds.values()):
        raise TypeError(f"counters are whole or floating numbers: {kinds}")
    output = StructType(
        [
            *[timed.schema[c] for c in kept],
            *[StructField(f"{c}_rate", DoubleType()) for c in counters],
            StructField("reset", BooleanType()),
            StructField("late", BooleanType()),
        ]
    )
    held = StructType(
        [StructField("at", LongType())]
        + [StructField(f"c{i}", LongType() if kinds[c] in _WHOLE else DoubleType()) for i, c in enumerate(counters)]
    )
    rates = _Rates(counters, ["_at", *seq], kept, output.names, held, to_micros(forget) // 1000)
    return timed.groupBy(*keys).transformWithState(rates, output, "append", "EventTime")
