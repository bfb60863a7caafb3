import threading
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_plans import final_plan
from test_streaming import SAMPLES, Feed, sample

from fleetstats.operators.rates import counter_rate
from fleetstats.operators.series import tail
from fleetstats.plans import files
from fleetstats.plans.carry import carried_samples, counter_rate_run
from fleetstats.schemas import HISTORY
from fleetstats.streaming.delivery import Outbox
from fleetstats.streaming.ingest import retained_history
from fleetstats.streaming.sinks import read_table, table_sink, write_stream
from fleetstats.streaming.tables import LandedTable

T0 = datetime(2024, 1, 1)


class Reader:
    """A target that is away in some of its calls and notes what it took."""

    def __init__(self, away=()):
        self.away, self.calls, self.took = set(away), 0, []

    def __call__(self, batch, batch_id):
        self.calls += 1
        if self.calls in self.away:
            raise ConnectionError("away")
        self.took.append((batch_id, sorted(r.b for r in batch.collect())))


def six(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SAMPLES)
    for i in range(6):
        feed.add(sample("h", "e", i, 2 * i), sample("h", "e", i, 2 * i + 1))
    return feed


WANT = [(i, [2 * i, 2 * i + 1]) for i in range(6)]


def test_a_target_that_was_away_gets_all_rows_once_and_others_are_written_once(spark, tmp_path):
    steady, shaky = Reader(), Reader(away={3, 4, 5})
    box, state = str(tmp_path / "box"), str(tmp_path / "state")
    query = write_stream(
        six(spark, tmp_path).stream(), {"steady": steady, "shaky": shaky}, optional=["shaky"], outbox=box, checkpoint=state, available_now=True
    )
    query.awaitTermination()
    assert steady.took == WANT and shaky.took == WANT
    # All have everything, so nothing is held; the three failures are on record.
    (folder,) = [n for n in files.names(spark, box) if n.startswith("query=")]
    assert files.names(spark, f"{box}/{folder}/held") == [] and files.names(spark, f"{box}/{folder}/batches") == []
    failures = sorted((r.batch_id, r.target) for r in spark.read.parquet(f"{box}/failures").collect())
    assert failures == [(2, "shaky")] * 3


def test_a_required_target_stops_the_stream_and_nobody_is_sent_a_batch_twice(spark, tmp_path):
    steady, shaky = Reader(), Reader(away={2})
    box, state, stream = str(tmp_path / "box"), str(tmp_path / "state"), six(spark, tmp_path).stream()

    def go():
        write_stream(stream, {"steady": steady, "shaky": shaky}, outbox=box, checkpoint=state, available_now=True).awaitTermination()

    with pytest.raises(StreamingQueryException):
        go()
    assert steady.took == WANT[:2] and shaky.took == WANT[:1]
    go()
    assert steady.took == WANT and shaky.took == WANT


def test_what_is_missing_at_the_end_is_sent_later(spark, tmp_path):
    shaky, sink = Reader(away={2, 3, 4, 5, 6}), table_sink(str(tmp_path / "t"))
    box = Outbox(str(tmp_path / "box"), {"table": sink, "shaky": shaky}, optional=["shaky"])
    for i in range(4):
        box(spark.createDataFrame([("h", "e", T0, i)], SAMPLES), i)
    assert [b for b, _ in shaky.took] == [0] and read_table(spark, sink.path, SAMPLES).count() == 4
    assert box.redeliver(spark, SAMPLES).keys() == {"shaky"}
    assert box.redeliver(spark, SAMPLES).keys() == {"shaky"}
    assert box.redeliver(spark, SAMPLES) == {} and [b for b, _ in shaky.took] == [0, 1, 2, 3]


def points(spark, i, n=30):
    rows = [(f"h{k % 4}", T0 + timedelta(hours=7 * i, seconds=k), float(i), float(k)) for k in range(n)]
    return spark.createDataFrame(rows, HISTORY)


def test_batches_are_compacted_under_a_running_reader(spark, tmp_path):
    landing, seen, stop, broken = LandedTable(str(tmp_path / "t"), compact_every=3), [], threading.Event(), []

    def read():
        while not stop.is_set():
            try:
                seen.append(landing.read(spark, HISTORY).count())
            except Exception as error:
                broken.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for i in range(28):
            landing(points(spark, i), i)
    finally:
        stop.set()
        reader.join()
    assert not broken and seen == sorted(seen) and all(n % 30 == 0 for n in seen)
    live = landing.manifest(spark).live
    assert sorted(n[:2] for n in live) == ["l0", "l3"]
    want = sorted((r.host, r.ts, r.cpu_avg) for i in range(28) for r in points(spark, i).collect())
    assert sorted((r.host, r.ts, r.cpu_avg) for r in landing.read(spark, HISTORY).collect()) == want
    # Folders are deleted one compaction after they were joined.
    assert len(files.names(spark, f"{landing.path}/rows")) < 10
    # A repeated batch changes nothing, whether compacted or not.
    for i in (27, 5):
        landing(points(spark, i), i)
    assert landing.read(spark, HISTORY).count() == 28 * 30


def test_a_tail_by_kept_counts_reads_the_last_days_only(spark, tmp_path):
    landing = LandedTable(str(tmp_path / "t"), compact_every=4)
    for i in range(9):
        landing(points(spark, i), i)
    rows = landing.read(spark, HISTORY)
    got = retained_history(spark, landing.path, 10)
    want = tail(rows.drop("date"), 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = final_plan(got)
    scans = [line for line in plan.splitlines() if "FileScan" in line and "cpu_avg" in line]
    assert len(scans) == 1 and "isnotnull(date), (date >= 2024-01-03)" in scans[0].split("PartitionFilters: [")[1].split("]")[0]
    counted = {(r.host, r._slice): r._rows for r in landing.counts(spark, HISTORY).collect()}
    assert sum(counted.values()) == 9 * 30


def test_points_without_a_time_land_and_are_the_oldest(spark, tmp_path):
    landing = LandedTable(str(tmp_path / "t"))
    landing(spark.createDataFrame([("h", None, 1.0, 1.0), ("h", T0, 2.0, 2.0), (None, T0, 3.0, 3.0)], HISTORY), 0)
    assert sorted(r.cpu_avg for r in retained_history(spark, landing.path, 5).collect()) == [1.0, 2.0, 3.0]
    assert sorted(r.cpu_avg for r in retained_history(spark, landing.path, 1).collect()) == [2.0, 3.0]
    assert LandedTable(str(tmp_path / "none")).read(spark, HISTORY).count() == 0


def test_runs_carry_the_last_samples_and_may_be_repeated(spark, tmp_path):
    rows = [("h", k, T0 + timedelta(seconds=10 * i + j), (37 * i + 11 * j) % 50) for i in range(9) for j, k in enumerate(("a", "b")) if i % 4 or k == "a"]
    frame = spark.createDataFrame(rows, "host string, name string, ts timestamp, b bigint")
    store = str(tmp_path / "carry")
    cuts = [T0, T0 + timedelta(seconds=30), T0 + timedelta(seconds=60), T0 + timedelta(seconds=900)]

    def part(i):
        return frame.where((F.col("ts") >= cuts[i]) & (F.col("ts") < cuts[i + 1]))

    def rates(i, name):
        return sorted(map(tuple, counter_rate_run(part(i), store, name, ["b"]).collect()))

    first, second, third = rates(0, "mon"), rates(1, "tue"), rates(2, "wed")
    assert rates(1, "tue") == second and rates(0, "mon") == first and rates(2, "wed") == third
    assert sorted(first + second + third) == sorted(map(tuple, counter_rate(frame, ["b"]).collect()))
    assert len(files.names(spark, f"{store}/runs")) == 3 and carried_samples(spark, store).count() == 2
    assert carried_samples(spark, store, "mon") is None
