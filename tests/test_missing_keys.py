"""One result whatever the keys and sizes: NULL keys and times, equal times, hot keys, a bad clock."""

from datetime import datetime, timedelta

import pytest

from fleetstats.operators.asof import as_of
from fleetstats.operators.assemble import disk_usage, process_table, with_addrs
from fleetstats.operators.containers import container_metrics
from fleetstats.operators.flatten import zero_fill
from fleetstats.operators.rates import counter_rate
from fleetstats.operators.series import latest, tail, trend
from fleetstats.plans.slices import cut, hot_keys

T0 = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def points(spark):
    data = [(h, at(t), i, float(i)) for i, (h, t) in enumerate((h, t) for h in ("a", None, "b") for t in (*range(0, 60, 5), 10, 10, None, None))]
    data += [("lone", at(-10**8), 900, 1.0), ("a", at(-10**9), 901, 2.0)]
    return spark.createDataFrame(data, "host string, ts timestamp, i bigint, v double")


def test_tail_keeps_hosts_without_a_name_and_is_the_same_for_hot_ones(spark, points):
    plain, hot = (tail(points, 4, ts="ts", seq=["i"], hot_rows=n) for n in (10**6, 2))
    assert rows(plain) == rows(hot)
    assert {r.host: r["count"] for r in plain.groupBy("host").count().collect()} == {"a": 4, None: 4, "b": 4, "lone": 1}
    with_map = points.selectExpr("*", "map('k', v) AS m")
    assert tail(with_map, 4, hot_rows=2).count() == 13
    assert {r.host for r in latest(points, seq=["i"]).collect()} == {"a", None, "b", "lone"}


def test_rates_are_the_same_for_hot_keys(spark, points):
    for elapsed in ("key", "tick"):
        plain, hot = (
            counter_rate(points, ["v"], keys=["host"], seq=["i"], elapsed=elapsed, hot_rows=n) for n in (10**6, 2)
        )
        assert rows(plain) == rows(hot), elapsed


def test_as_of_ignores_right_rows_without_a_time_whatever_the_size(spark, points):
    right = spark.createDataFrame([("a", None, 7.0), (None, at(20), 8.0), ("b", at(11), 9.0), ("b", None, 1.0)], "host string, ts timestamp, w double")
    plain, hot = (as_of(points, right, ["w"], hot_rows=n) for n in (10**6, 2))
    assert rows(plain) == rows(hot)
    assert {r.w for r in plain.where("host = 'a'").collect()} == {None}
    assert {r.w for r in plain.where("host is null and ts >= '2024-01-01 00:00:20'").collect()} == {8.0}
    assert plain.where("ts is null and w is not null").count() == 0


def test_one_bad_clock_does_not_stretch_the_pieces(spark):
    df = spark.range(20000).selectExpr("'h' AS host", "timestamp_micros(1704067200000000 + id * 1000000) AS ts")
    df = df.union(spark.sql("SELECT 'h', timestamp'1970-01-01'"))
    pieces = cut(df, hot_keys(df, ["host"], "ts", 2000), ["host"], "ts").groupBy("_piece").count()
    assert pieces.count() > 100 and pieces.agg({"count": "max"}).first()[0] < 500


def test_missing_readings_have_no_place_in_a_trend(spark):
    df = spark.createDataFrame([(None, at(0), None, 5.0), (None, at(10), 150.0, None)], "host string, ts timestamp, cpu_avg double, mem_percent double")
    got = {r.x: (r.cpu_avg_y, r.mem_percent_y) for r in trend(df).collect()}
    assert got == {0.0: (None, 0.05), 1.0: (1.0, None)}


def test_zero_form_of_a_snapshot_goes_within(spark):
    ddl = "system struct<hostname:string,uptime:bigint>, disks array<struct<device:string,total:bigint>>, gone array<int>, flag boolean"
    df = spark.createDataFrame([(None, [(None, None), None], None, None), (("h", None), [], [None, 3], True)], ddl)
    one, two = (r.asDict(recursive=True) for r in zero_fill(df).collect())
    assert one == {"system": {"hostname": "", "uptime": 0}, "disks": [{"device": "", "total": 0}] * 2, "gone": None, "flag": None}
    assert two == {"system": {"hostname": "h", "uptime": 0}, "disks": [], "gone": [0, 3], "flag": True}


def test_parts_of_a_snapshot_without_a_host_find_each_other(spark):
    """A missing host is a host in the joins of addresses, usage, attributes and container stats."""
    tick = "host string, ts timestamp"
    at_null = spark.createDataFrame([(None, T0, "e0")], f"{tick}, name string")
    addrs = spark.createDataFrame([(None, T0, "e0", 1, "10.0.0.1")], f"{tick}, name string, seq int, addr string")
    assert with_addrs(at_null, addrs).first().addrs == "10.0.0.1"
    parts = spark.createDataFrame([(None, T0, 1, "sda", "/")], f"{tick}, seq int, device string, mountpoint string")
    usage = spark.createDataFrame([(None, T0, "/", 10)], f"{tick}, mountpoint string, total bigint")
    assert [(r.device, r.total) for r in disk_usage(parts, usage).collect()] == [("sda", 10)]
    pids = spark.createDataFrame([(None, None, 7)], f"{tick}, pid int")
    names = pids.selectExpr("*", "'init' AS name")
    assert process_table(pids, {"name": names}).first().name == "init"
    listed = spark.createDataFrame([(None, T0, "c", "running")], f"{tick}, id string, state string")
    stats = spark.createDataFrame([(None, T0, "c", 1.5, 2, 3)], f"{tick}, id string, cpu_pct double, mem_usage bigint, mem_limit bigint")
    assert container_metrics(listed, stats).first().mem_usage == 2
