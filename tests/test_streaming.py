import json
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from fleetstats.operators.rates import counter_rate
from fleetstats.operators.series import latest
from fleetstats.schemas import CONTAINERS, HISTORY, SNAPSHOT
from fleetstats.sources.messages import decode
from fleetstats.streaming.ingest import ingest, record_history, retained_history
from fleetstats.streaming.rates import stream_counter_rate
from fleetstats.streaming.sinks import FanOut, read_table, start, table_sink, write_stream
from fleetstats.streaming.tables import LandedTable
from fleetstats.streaming.views import newest_updates, stream_latest, stream_sample, stream_sessions

T0 = datetime(2024, 1, 1)
SAMPLES = "host string, name string, ts timestamp, b bigint"


class Feed:
    """A folder of JSON files, read one file per micro-batch in the order they were added."""

    def __init__(self, spark, folder, ddl):
        self.spark, self.folder, self.ddl, self.files = spark, folder, ddl, 0
        folder.mkdir()

    def add(self, *rows):
        path = self.folder / f"{self.files:03}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_700_000_000 + self.files, 1_700_000_000 + self.files))
        self.files += 1

    def stream(self):
        reader = self.spark.readStream.schema(self.ddl).option("maxFilesPerTrigger", 1)
        return reader.json(str(self.folder))

    def table(self):
        return self.spark.read.schema(self.ddl).json(str(self.folder))


def sample(host, name, seconds, b):
    at = (T0 + timedelta(seconds=seconds)).isoformat()
    return {"host": host, "name": name, "ts": at, "b": b}


def run(stream, tmp_path, mode="append", name="out"):
    path, state = str(tmp_path / name), str(tmp_path / f"{name}-state")
    query = start(stream, table_sink(path), checkpoint=state, mode=mode, available_now=True)
    query.awaitTermination()
    return read_table(stream.sparkSession, path, stream.schema)


def by_key(df):
    return {
        (r.host, r.name, (r.ts - T0).total_seconds()): (r.b_rate, r.reset, r.late if "late" in r else False)
        for r in df.collect()
    }


def test_rates_over_many_batches_equal_the_batch_operator(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SAMPLES)
    hosts = [("hot", "e0"), ("hot", "e0"), ("hot", "e1"), ("a", "e0"), ("b", "e0")]
    for batch in range(4):
        feed.add(
            *[
                sample(*hosts[i % 5], 100 * batch + 7 * i % 90, (i * 37 + batch * 11) % 101)
                for i in range(30)
                if not (batch == 2 and i % 5 == 3)
            ]
        )
    got = run(stream_counter_rate(feed.stream(), ["b"], seq=["b"]), tmp_path)
    want = counter_rate(feed.table(), ["b"], seq=["b"])
    shape = ["host", "name", "ts", "b", "b_rate", "reset"]
    assert sorted(map(tuple, got.select(shape).collect())) == sorted(map(tuple, want.select(shape).collect()))
    assert got.where("late").count() == 0


def test_late_samples_stay_and_leave_the_state_alone(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SAMPLES)
    feed.add(sample("h", "e", 0, 100), sample("h", "e", 10, 200))
    feed.add(sample("h", "e", 5, 999), sample("h", "e", 20, 300))
    got = by_key(run(stream_counter_rate(feed.stream(), ["b"]), tmp_path))
    assert got[("h", "e", 5)] == (0.0, False, True)
    assert got[("h", "e", 20)] == (10.0, False, False)


def test_missing_readings_on_a_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SAMPLES)
    big = 2**62 + 1
    feed.add(sample("h", "e", 0, big), sample("h", "e", 10, None))
    feed.add(sample("h", "e", 20, 15), sample("h", "e", 30, 25), sample("g", "e", 0, None))
    got = by_key(run(stream_counter_rate(feed.stream(), ["b"]), tmp_path))
    assert got[("h", "e", 10)][0] is None
    assert got[("h", "e", 20)] == (0.0, False, False)
    assert got[("h", "e", 30)] == (1.0, False, False)
    assert got == by_key(counter_rate(feed.table(), ["b"]))


def test_silent_keys_are_forgotten(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SAMPLES)
    feed.add(sample("h", "e", 0, 100), sample("g", "e", 0, 100))
    feed.add(sample("g", "e", 7200, 200))
    feed.add(sample("g", "e", 7210, 210))
    feed.add(sample("h", "e", 7220, 900), sample("g", "e", 7220, 230))
    stream = stream_counter_rate(feed.stream(), ["b"], forget="1 hour")
    got = by_key(run(stream, tmp_path))
    assert got[("h", "e", 7220)] == (0.0, False, False)
    assert got[("g", "e", 7220)] == (2.0, False, False)


def test_a_silent_key_leaves_the_state_by_its_timer(spark, tmp_path):
    """``h`` is heard once more before its first timer fires, and only goes an hour after that."""
    feed = Feed(spark, tmp_path / "in", SAMPLES)
    stream = stream_counter_rate(feed.stream(), ["b"], forget="1 hour")
    state = str(tmp_path / "out-state")

    def alive():
        rows = spark.read.format("statestore").option("stateVarName", "newest").load(state)
        return {r.key.host: r.value.c0 for r in rows.collect()}

    feed.add(sample("h", "e", 0, 100), sample("g", "e", 0, 100))
    feed.add(sample("h", "e", 1800, 150))
    feed.add(sample("g", "e", 4000, 200))
    run(stream, tmp_path)
    assert alive() == {"h": 150, "g": 200}
    feed.add(sample("g", "e", 5400, 300))
    run(stream_counter_rate(feed.stream(), ["b"], forget="1 hour"), tmp_path)
    assert alive() == {"g": 300}


def test_open_ticks_are_the_newest_of_what_changed(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SAMPLES)
    feed.add(sample("h", "e", 0, 1), sample("h", "e", 70, 3))
    feed.add(sample("h", "e", 50, 2), sample("g", "e", 10, 9))
    landed = run(stream_sample(feed.stream(), "1 minute", ["b"], late="1 hour"), tmp_path, "update")
    assert landed.count() == 4
    got = {(r.host, (r.tick - T0).seconds): r.b for r in newest_updates(landed).collect()}
    assert got == {("h", 0): 2, ("h", 60): 3, ("g", 0): 9}


def test_a_restarted_stream_goes_on_from_its_state(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SAMPLES)
    feed.add(sample("h", "e", 0, 100))
    run(stream_counter_rate(feed.stream(), ["b"]), tmp_path)
    feed.add(sample("h", "e", 10, 150))
    got = by_key(run(stream_counter_rate(feed.stream(), ["b"]), tmp_path))
    assert got == {("h", "e", 0): (0.0, False, False), ("h", "e", 10): (5.0, False, False)}


def test_latest_in_update_mode(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SAMPLES)
    feed.add(sample("h", "e", 0, 1), sample("h", "e", 5, 2), sample("g", "e", 1, 3))
    feed.add(sample("h", "e", 3, 9), sample("g", "e", 2, 4))
    table = run(stream_latest(feed.stream()), tmp_path, "update")
    assert sorted((r.host, r.b) for r in latest(table).collect()) == [("g", 4), ("h", 2)]


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SAMPLES)
    feed.add(sample("h", "e", 0, 1), sample("h", "e", 1800, 2))
    feed.add(sample("h", "e", 6000, 3))
    feed.add(sample("g", "e", 20000, 4))
    stream = stream_sessions(feed.stream(), late="10 minutes")
    got = run(stream, tmp_path).collect()
    assert sorted((r.host, (r.session_start - T0).total_seconds(), r.messages) for r in got) == [
        ("h", 0.0, 2),
        ("h", 6000.0, 1),
    ]


def test_ticks_close_behind_the_watermark(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SAMPLES)
    feed.add(sample("h", "e", 0, 1), sample("h", "e", 50, 2), sample("h", "e", 70, 3))
    feed.add(sample("h", "e", 4000, 4))
    got = run(stream_sample(feed.stream(), "1 minute", ["b"], late="1 minute"), tmp_path).collect()
    assert sorted(((r.tick - T0).total_seconds(), r.b) for r in got) == [(0.0, 2), (60.0, 3)]


def test_an_optional_target_is_recorded_and_tried_again(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SAMPLES)
    feed.add(sample("h", "e", 0, 1))
    feed.add(sample("h", "e", 1, 2))
    tried, failures, kept = [], str(tmp_path / "failures"), str(tmp_path / "kept")

    def shaky(batch, batch_id):
        tried.append(batch_id)
        if batch_id == 0:
            raise ConnectionError("gone")

    query = write_stream(feed.stream(), {"shaky": shaky, "kept": kept}, failures, ["shaky"], available_now=True)
    query.awaitTermination()
    assert read_table(spark, kept, SAMPLES).count() == 2
    assert tried == [0, 1]
    (recorded,) = spark.read.parquet(failures).collect()
    assert (recorded.batch_id, recorded.target) == (0, "shaky") and "ConnectionError" in recorded.error
    with pytest.raises(ValueError):
        FanOut({"shaky": shaky}, optional=["shaky"])


def test_a_target_that_fails_once_misses_no_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SAMPLES)
    for second in range(4):
        feed.add(sample("h", "e", second, second))
    kept, once, failed = str(tmp_path / "kept"), table_sink(str(tmp_path / "once")), []

    def fails_once(batch, batch_id):
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise ConnectionError("gone")
        once(batch, batch_id)

    targets = {"once": fails_once, "kept": kept}
    with pytest.raises(StreamingQueryException):
        write_stream(feed.stream(), targets, available_now=True).awaitTermination()
    write_stream(feed.stream(), targets, available_now=True).awaitTermination()
    for path in (kept, once.path):
        assert sorted(r.b for r in read_table(spark, path, SAMPLES).collect()) == [0, 1, 2, 3]


def test_a_fan_out_fails_after_serving_the_others(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    kept = str(tmp_path / "kept")

    def gone(batch, batch_id):
        raise ConnectionError("gone")

    with pytest.raises(RuntimeError):
        FanOut({"gone": gone, "kept": kept})(df, 0)
    assert read_table(spark, kept, "a int").count() == 1


def test_another_stream_never_replaces_landed_rows(spark, tmp_path):
    first, second = Feed(spark, tmp_path / "one", SAMPLES), Feed(spark, tmp_path / "two", SAMPLES)
    first.add(sample("h", "e", 0, 1))
    second.add(sample("h", "e", 0, 2))
    sink = table_sink(str(tmp_path / "t"))
    start(first.stream(), sink, available_now=True).awaitTermination()
    start(first.stream(), sink, available_now=True).awaitTermination()
    start(second.stream(), sink, checkpoint=str(tmp_path / "state"), available_now=True).awaitTermination()
    assert sorted(r.b for r in read_table(spark, sink.path, SAMPLES).collect()) == [1, 2]
    with pytest.raises(ValueError):
        start(first.stream(), lambda batch, batch_id: None)


def test_very_late_rows_and_backlogs_of_new_keys_stay(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SAMPLES)
    feed.add(sample("h", "e", 7200, 100))
    feed.add(sample("h", "e", 7210, 200))
    feed.add(sample("h", "e", 0, 5), *[sample("new", "e", t, t) for t in (0, 10, 20)])
    got = by_key(run(stream_counter_rate(feed.stream(), ["b"]), tmp_path))
    assert len(got) == 6 and got[("h", "e", 0)] == (0.0, False, True)
    assert [got[("new", "e", t)] for t in (0, 10, 20)] == [(0.0, False, False), (1.0, False, False), (1.0, False, False)]


def test_fractions_are_kept_on_a_stream(spark, tmp_path):
    ddl = SAMPLES.replace("b bigint", "b double")
    feed = Feed(spark, tmp_path / "in", ddl)
    for second in range(4):
        feed.add(sample("h", "e", second, 1.5 * second))
    got = by_key(run(stream_counter_rate(feed.stream(), ["b"]), tmp_path))
    assert [got[("h", "e", t)][0] for t in range(4)] == [0.0, 1.5, 1.5, 1.5]
    with pytest.raises(TypeError):
        stream_counter_rate(feed.stream().withColumn("b", F.col("b").cast("string")), ["b"])


def test_payloads_that_do_not_parse_are_rejected_with_their_text(spark, tmp_path):
    good = [
        '{"type":"docker","payload":[]}',
        '{"type":"history","payload":[{"t":1,"c":1.0,"m":2.0}]}',
        '{"type":"snapshot","payload":{"timestamp":1,"system":{"hostname":"h"}}}',
    ]
    bad = [
        '{"type":"docker","payload":"junk"}', '{"type":"docker"}', '{"type":"history","payload":"junk"}', '{"type":"history","payload":{"x":1}}',
        '{"type":"snapshot","payload":"junk"}', '{"type":"snapshot","payload":{}}', "{}", "junk", '{"type":"other","payload":1}',
    ]
    lines = spark.createDataFrame([(v,) for v in good + bad], "value string")
    routes = {r.value: r.route for r in decode(lines).collect()}
    assert [routes[v] for v in good] == ["docker", "history", "snapshot"]
    assert [routes[v] for v in bad] == ["corrupt"] * 8 + ["unknown"]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    sink = table_sink(str(tmp_path / "t"))
    df = spark.createDataFrame([(1,)], "a int")
    sink(df, 0)
    sink(df, 0)
    sink(df, 1)
    assert read_table(spark, str(tmp_path / "t"), "a int").count() == 2


def test_a_timed_stream_keeps_going(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SAMPLES)
    feed.add(sample("h", "e", 0, 1))
    path = str(tmp_path / "t")
    query = start(feed.stream(), table_sink(path), interval_ms=100)
    try:
        query.processAllAvailable()
        feed.add(sample("h", "e", 1, 2))
        deadline = time.time() + 60
        while time.time() < deadline and read_table(spark, path, SAMPLES).count() < 2:
            time.sleep(0.2)
        assert read_table(spark, path, SAMPLES).count() == 2
        assert query.isActive
    finally:
        query.stop()


def test_ingest_lands_every_kind_and_rejects_the_rest(spark, tmp_path):
    snapshot = {"timestamp": 1704067200000, "system": {"hostname": "h"}, "cpu": {"avgUsage": 5.0}, "memory": {"usedPercent": 7.0}}
    texts = [
        {"type": "snapshot", "payload": snapshot},
        snapshot,
        {"type": "history", "payload": [{"t": 1, "c": 1.0, "m": 2.0}, {"t": 2, "c": 3.0, "m": 4.0}]},
        {"type": "docker", "payload": [{"id": "a", "state": "running"}]},
        {"type": "docker", "payload": []},
        {"type": "docker", "payload": None},
        {"type": "weather"},
    ]
    feed = Feed(spark, tmp_path / "in", "host string, ts timestamp, value string")
    lines = [{"host": "h", "ts": T0.isoformat(), "value": json.dumps(t)} for t in texts]
    feed.add(*lines)
    feed.add({"host": "h", "ts": T0.isoformat(), "value": "{broken"}, lines[0])
    tables = str(tmp_path / "tables")
    ingest(feed.stream(), tables, available_now=True).awaitTermination()
    counts = {
        name: read_table(spark, f"{tables}/{name}", schema).count()
        for name, schema in {"snapshots": SNAPSHOT, "history": HISTORY, "containers": CONTAINERS}.items()
    }
    assert counts == {"snapshots": 3, "history": 2, "containers": 1}
    rejected = read_table(spark, f"{tables}/rejected", "host string, ts timestamp, value string, route string")
    assert sorted(r.route for r in rejected.collect()) == ["corrupt", "corrupt", "unknown"]


def test_history_is_recorded_per_snapshot(spark, tmp_path):
    folder = str(tmp_path / "snaps")
    row = ("h", T0, None, (None, 1, 1, [4.0], 4.0), (1, 1, 1, 6.0, 0, 0, 0.0), None, None, None, None)
    spark.createDataFrame([row], SNAPSHOT).write.parquet(folder)
    path = str(tmp_path / "history")
    record_history(spark.readStream.schema(SNAPSHOT).parquet(folder), path, available_now=True).awaitTermination()
    point = LandedTable(path).read(spark, HISTORY).select(F.col("cpu_avg"), F.col("mem_percent")).first()
    assert tuple(point) == (4.0, 6.0)
    assert [tuple(r)[2:] for r in retained_history(spark, path).collect()] == [(4.0, 6.0)]
