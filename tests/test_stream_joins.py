import json
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_streaming import T0, Feed, run

from fleetstats.operators.asof import as_of
from fleetstats.operators.containers import containers
from fleetstats.plans.catalog_stream_joins import in_files
from fleetstats.plans.staging import session_folder
from fleetstats.schemas import CONTAINER_LIST, CONTAINER_STATS
from fleetstats.sources.snapshots import read_containers
from fleetstats.streaming.joins import stream_as_of, stream_assemble, stream_backfill, stream_containers
from fleetstats.streaming.sinks import read_table, start, table_sink


def at(seconds):
    return (T0 + timedelta(seconds=seconds)).isoformat()


def part(host, seconds, **values):
    return {"host": host, "ts": at(seconds), **values}


def test_a_tick_is_sent_when_its_parts_are_there_or_its_wait_is_over(spark, tmp_path):
    load = Feed(spark, tmp_path / "load", "host string, ts timestamp, load1 double, load5 double")
    disks = Feed(spark, tmp_path / "disks", "host string, ts timestamp, disks array<string>")
    load.add(part("a", 0, load1=1.0, load5=2.0), part("b", 0, load1=3.0, load5=4.0))
    disks.add(part("a", 10, disks=["x"]))
    load.add(part("a", 10, load1=5.0, load5=6.0), part("a", 10, load1=9.0, load5=9.0))
    disks.add(part("a", 0, disks=["y", "z"]), part("c", 5, disks=None))
    load.add(part("d", 100, load1=0.0, load5=0.0))
    disks.add(part("d", 100, disks=[]))
    load.add(part("d", 101, load1=0.0, load5=0.0))
    disks.add(part("d", 101, disks=[]))
    load.add(part("e", 200, load1=0.0, load5=0.0))
    disks.add(part("b", 0, disks=["late"]))
    stream = stream_assemble({"load": load.stream(), "disks": disks.stream()}, wait="30 seconds")
    got = {}
    for r in run(stream, tmp_path).collect():
        got.setdefault((r.host, (r.ts - T0).seconds), []).append((r.load and tuple(r.load), r.disks, r.complete))
    assert got[("a", 0)] == [((1.0, 2.0), ["y", "z"], True)]
    assert got[("a", 10)] == [((5.0, 6.0), ["x"], True)]
    assert got[("c", 5)] == [(None, None, False)]
    assert got[("d", 100)] == [((0.0, 0.0), [], True)]
    # The late part of b starts the tick anew.
    assert sorted(got[("b", 0)], key=repr) == [((3.0, 4.0), None, False), (None, ["late"], False)]
    assert ("e", 200) not in got


def test_as_of_takes_rows_in_the_order_of_their_times(spark, tmp_path):
    left = Feed(spark, tmp_path / "left", "host string, ts timestamp, n bigint")
    right = Feed(spark, tmp_path / "right", "host string, ts timestamp, seq bigint, v string")
    left.add(part("a", 50, n=1), part("a", 10, n=2), part("b", 5, n=3), {"host": "a", "ts": None, "n": 4})
    right.add(part("a", 20, seq=1, v="twenty"), part("a", 50, seq=1, v="early"), part("a", 50, seq=2, v="fifty"))
    left.add(part("a", 30, n=5), part("a", 500, n=6))
    right.add(part("a", 9, seq=1, v="nine"), {"host": "a", "ts": None, "seq": 1, "v": "never"}, part("b", 6, seq=1, v="after"))
    left.add(part("zz", 5000, n=7), part("a", 600, n=8))
    right.add(part("a", 550, seq=1, v=None), part("zz", 5000, seq=1, v="end"))
    stream = stream_as_of(left.stream(), right.stream(), ["v"], right_seq=["seq"], late="10 minutes")
    got = {r.n: (r.v, r.late) for r in run(stream, tmp_path).collect()}
    want = {r.n: (r.v, False) for r in as_of(left.table(), right.table(), ["v"], right_seq=["seq"]).collect()}
    assert got.pop(7, None) is None and want.pop(7)
    assert got == want
    assert got[1][0] == "fifty" and got[2][0] == "nine" and got[5][0] == "twenty" and got[3][0] is None and got[8] == (None, False)


def test_a_late_left_row_is_sent_with_what_is_known(spark, tmp_path):
    left = Feed(spark, tmp_path / "left", "host string, ts timestamp, n bigint")
    right = Feed(spark, tmp_path / "right", "host string, ts timestamp, v string")
    right.add(part("a", 0, v="zero"), part("a", 100, v="hundred"))
    left.add(part("a", 50, n=1))
    right.add(part("a", 1000, v="x"))
    left.add(part("a", 1000, n=2))
    right.add(part("a", 1001, v="y"))
    left.add(part("a", 20, n=3), part("a", 400, n=4))
    got = {r.n: (r.v, r.late) for r in run(stream_as_of(left.stream(), right.stream(), ["v"], late="1 minute"), tmp_path).collect()}
    assert got == {1: ("zero", False), 3: ("zero", True), 4: ("hundred", True)}


def document(host, seconds, id, used):
    cpu = {"cpu_usage": {"total_usage": used}, "system_cpu_usage": 1000, "online_cpus": 2}
    return {"host": host, "ts": at(seconds), "id": id, "cpu_stats": cpu, "precpu_stats": {}, "memory_stats": {"usage": used, "limit": 900}}


def listing(host, seconds, id, state):
    return {"host": host, "ts": at(seconds), "Id": id, "Names": [f"/{id}"], "Image": "i", "State": state, "Status": "", "Created": 0}


def test_containers_wait_for_their_stats_and_get_zeros_without(spark, tmp_path):
    lists, stats = Feed(spark, tmp_path / "lists", CONTAINER_LIST), Feed(spark, tmp_path / "stats", CONTAINER_STATS)
    lists.add(listing("h", 0, "one", "running"), listing("h", 0, "two", "exited"), listing("h", 0, "three", "running"))
    stats.add(document("h", 5, "one", 20))
    lists.add(listing("h", 5, "one", "running"), listing(None, 5, "four", "running"))
    stats.add(document("h", 0, "one", 10), document("h", 0, "two", 10), document(None, 5, "four", 30))
    lists.add(listing("h", 5000, "end", "running"))
    stats.add(document("h", 5000, "end", 1))
    listed, documents = read_containers(spark, str(lists.folder), str(stats.folder), streaming=True, options={"maxFilesPerTrigger": 1})
    got = run(stream_containers(listed, documents), tmp_path)
    want = containers(lists.table(), stats.table())
    kept = [c for c in want.columns if c != "created"]
    assert sorted(map(str, got.where("id <> 'end'").select(kept).collect())) == sorted(map(str, want.where("id <> 'end'").select(kept).collect()))
    assert got.where("id = 'three'").first().mem_usage == 0 and got.where("id = 'four'").first().mem_usage == 30
    with pytest.raises(ValueError):
        stream_containers(listed, documents, baseline="poll")


def test_the_live_point_wins_whichever_comes_first(spark, tmp_path):
    ddl = "host string, ts timestamp, v string, n bigint"
    history, live = Feed(spark, tmp_path / "history", ddl), Feed(spark, tmp_path / "live", ddl)
    history.add(part("a", 0, v="history", n=1), part("a", 1, v="history", n=1))
    live.add(part("a", 2, v="live", n=1), part("a", 3, v="live", n=1))
    history.add(part("a", 2, v="history", n=9), part("a", 3, v="history", n=1))
    live.add(part("a", 0, v="live", n=1), part("a", 0, v="live", n=2))
    history.add(part("b", 9000, v="end", n=1))
    live.add(part("b", 9000, v="end", n=1))
    got = run(stream_backfill(history.stream(), live.stream(), seq=["n"]), tmp_path).where("host = 'a'")
    assert sorted(((r.ts - T0).seconds, r.v, r.n) for r in got.collect()) == [(0, "live", 2), (1, "history", 1), (2, "live", 1), (3, "live", 1)]


def test_missing_hosts_and_times_are_groups_of_their_own(spark, tmp_path):
    rows = Feed(spark, tmp_path / "rows", "host string, ts timestamp, x double")
    others = Feed(spark, tmp_path / "others", "host string, ts timestamp, y double")
    rows.add({"host": None, "ts": at(0), "x": 1.0}, {"host": "a", "ts": None, "x": 2.0})
    others.add({"host": None, "ts": at(0), "y": 3.0}, {"host": "a", "ts": None, "y": 4.0})
    got = run(stream_assemble({"x": rows.stream(), "y": others.stream()}), tmp_path).collect()
    assert sorted((r.host or "", r.x, r.y, r.complete) for r in got) == [("", 1.0, 3.0, True), ("a", 2.0, 4.0, True)]


def timers(stream, tmp_path, name):
    """Timers that a stream set, and the rows it sent."""
    path = str(tmp_path / name)
    query = start(stream, table_sink(path), checkpoint=f"{path}-state", available_now=True)
    query.awaitTermination()
    found = [o.customMetrics["numRegisteredTimers"] for p in query.recentProgress for o in p.stateOperators]
    return sum(map(int, found)), read_table(stream.sparkSession, path, stream.schema)


def test_ticks_of_a_bucket_share_a_timer(spark, tmp_path):
    x, y = (Feed(spark, tmp_path / n, f"host string, ts timestamp, {n} bigint") for n in "xy")
    x.add(*[part(f"h{i}", i % 7, x=i) for i in range(0, 300, 2)], part("h0", 0, x=-1))
    y.add(*[part(f"h{i}", i % 7, y=i) for i in range(0, 300, 3)])
    x.add(*[part(f"h{i}", i % 7, x=i) for i in range(1, 300, 2)])
    y.add(*[part(f"h{i}", i % 7, y=-i) for i in range(1, 300, 3)], part("end", 9000, y=0))
    x.add(part("end", 9000, x=0))
    y.add(part("h2", 2, y=2))
    x.add(part("later", 99000, x=0))
    y.add(part("h5", 5, y=5))
    # h2 is still open when its part comes; that of h5 comes when its tick has been sent.
    want = {(f"h{i}", i, i if i % 3 == 0 else -i if i % 3 == 1 else None, i % 3 < 2) for i in range(300)}
    for buckets in (1, 5):
        count, got = timers(stream_assemble({"x": x.stream(), "y": y.stream()}, buckets=buckets), tmp_path, f"b{buckets}")
        rows = [(r.host, r.x, r.y, r.complete) for r in got.where("host LIKE 'h%'").collect()]
        assert len(rows) == 301 and set(rows) == (want - {("h2", 2, None, False)}) | {("h2", 2, 2, True), ("h5", None, 5, False)}
        assert 0 < count <= 12 * buckets


def test_a_condition_is_a_micro_batch_of_as_many_files_as_its_rows_need(spark):
    df = spark.range(0, 95, 1, 4).selectExpr("id AS host", "CAST(NULL AS timestamp) AS ts")
    stream = in_files(df, "host < 80", "host = 90", "host > 200", "host = 94", file_rows=20)
    batches = []

    def keep(batch, _):
        batches.append(sorted((r[0], r[1]) for r in batch.select("host", F.input_file_name()).collect()))

    start(stream, keep, checkpoint=f"{session_folder(spark, 'state')}/x", available_now=True).awaitTermination()
    assert [h for h, _ in batches[0]] == [*range(80)] and [[h for h, _ in b] for b in batches[1:] if b] == [[90], [94]]
    sizes = Counter(f for _, f in batches[0])
    assert len(sizes) == 4 and max(sizes.values()) < 40


def test_as_of_of_a_bucket_shares_a_timer_and_mixes_no_keys(spark, tmp_path):
    left = Feed(spark, tmp_path / "left", "host string, ts timestamp, n bigint")
    right = Feed(spark, tmp_path / "right", "host string, ts timestamp, seq bigint, v bigint")
    for round in range(3):
        left.add(*[part(f"h{i}", 1000 * round + 7 * i % 900, n=1000 * round + i) for i in range(0, 200)], part(None, 1000 * round + 50, n=9000 + round))
        right.add(*[part(f"h{i}", 1000 * round + 11 * i % 900, seq=i, v=1000 * round + i) for i in range(0, 200, 2)], part(None, 1000 * round, seq=0, v=-round))
    left.add(part("end", 90000, n=-1))
    right.add(part("end", 90000, seq=0, v=-1))
    want = as_of(left.table(), right.table(), ["v"], right_seq=["seq"]).where("n >= 0")
    want = sorted((r.n, r.v if r.v is not None else "none") for r in want.collect())
    for buckets in (1, 5):
        stream = stream_as_of(left.stream(), right.stream(), ["v"], right_seq=["seq"], late="10 minutes", buckets=buckets)
        count, got = timers(stream, tmp_path, f"b{buckets}")
        assert sorted((r.n, r.v if r.v is not None else "none") for r in got.where("n >= 0 AND NOT late").collect()) == want
        assert 0 < count <= 12 * buckets
