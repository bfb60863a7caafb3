from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetstats.operators.asof import as_of
from fleetstats.operators.rates import counter_rate
from fleetstats.operators.series import backfill_union, extent, latest, sample, tail, trend
from fleetstats.operators.sessions import idle_sessions
from fleetstats.plans.slices import with_previous

T0 = datetime(2024, 1, 1)
once = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
# One host far busier than the others; times within and across slices, some equal.
points = st.lists(
    st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]), st.integers(0, 7200)), min_size=1, max_size=80
)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def samples(spark, rows):
    return frame(spark, [(h, n, at(s), b) for h, n, s, b in rows], "host string, name string, ts timestamp_ntz, b bigint")


def rates(df):
    return {(r.host, r.name, (r.ts - T0).total_seconds()): (r.b_rate, r.reset) for r in df.collect()}


def test_rate_first_growth_reset_and_return(spark):
    rows = [("h", "eth0", 0, 100), ("h", "eth0", 10, 200), ("h", "eth0", 20, 50), ("h", "eth0", 1000, 148)]
    got = rates(counter_rate(samples(spark, rows), ["b"]))
    assert got == {
        ("h", "eth0", 0): (0.0, False),
        ("h", "eth0", 10): (10.0, False),
        ("h", "eth0", 20): (0.0, True),
        ("h", "eth0", 1000): (0.1, False),
    }


def test_what_a_counter_that_went_back_gives_is_chosen(spark):
    rows = samples(spark, [("h", "e", 0, 100), ("h", "e", 10, 40), ("h", "e", 20, 60)])
    for reset, value in (("clamp", 0.0), ("null", None), ("restart", 4.0)):
        got = rates(counter_rate(rows, ["b"], reset=reset))
        assert got == {("h", "e", 0): (0.0, False), ("h", "e", 10): (value, True), ("h", "e", 20): (2.0, False)}
        tail_of = counter_rate(rows.where("b < 100"), ["b"], reset=reset, carried=rows.where("b = 100"))
        assert rates(tail_of)[("h", "e", 10)] == (value, True)
    with pytest.raises(ValueError):
        counter_rate(rows, ["b"], reset="wrap")


def test_hot_interfaces_have_the_same_rates(spark):
    rows = [("h", f"e{i % 2}", 10 * (i // 2), i * i % 37) for i in range(60)] + [("g", "e0", 5, 1)]
    df = samples(spark, rows)
    for elapsed in ("key", "tick"):
        whole = rates(counter_rate(df, ["b"], elapsed=elapsed))
        assert rates(counter_rate(df, ["b"], elapsed=elapsed, hot_rows=10)) == whole


def test_equal_times_count_as_one_second(spark):
    rows = samples(spark, [("h", "e", 5, 10), ("h", "e", 5, 30)])
    assert sorted(r.b_rate for r in counter_rate(rows, ["b"], seq=["b"]).collect()) == [0.0, 20.0]


def test_elapsed_by_tick_is_the_hosts_previous_sample(spark):
    rows = [("h", "e0", 0, 0), ("h", "e1", 0, 0), ("h", "e0", 10, 10), ("h", "e0", 20, 20), ("h", "e1", 20, 100)]
    df = samples(spark, rows)
    assert rates(counter_rate(df, ["b"]))[("h", "e1", 20)] == (5.0, False)
    assert rates(counter_rate(df, ["b"], elapsed="tick"))[("h", "e1", 20)] == (10.0, False)
    only_e1 = df.where("name = 'e1'")
    assert rates(counter_rate(only_e1, ["b"], elapsed="tick", ticks=df))[("h", "e1", 20)] == (10.0, False)
    with pytest.raises(ValueError):
        counter_rate(df, ["b"], elapsed="other")


def test_missing_reading_has_no_rate(spark):
    rows = [("h", "e", 0, 5), ("h", "e", 10, None), ("h", "e", 20, 15)]
    got = rates(counter_rate(samples(spark, rows), ["b"]))
    assert got[("h", "e", 10)] == (None, False)
    assert got[("h", "e", 20)] == (0.0, False)


def test_two_counters_share_one_reset(spark):
    rows = [("h", "e", at(0), 10, 10), ("h", "e", at(2), 20, 5)]
    df = frame(spark, rows, "host string, name string, ts timestamp, bytes_sent bigint, bytes_recv bigint")
    last = counter_rate(df).where(F.col("ts") == F.lit(at(2))).first()
    assert (last.bytes_sent_rate, last.bytes_recv_rate, last.reset) == (5.0, 0.0, True)


@pytest.mark.parametrize("hot_rows", [8, 10**6])
@once
@given(points)
def test_previous_row_is_that_of_the_whole_key(spark, hot_rows, points):
    rows = [(h, at(s), i) for i, (h, s) in enumerate(points)]
    df = frame(spark, rows, "host string, ts timestamp_ntz, id bigint")
    got = with_previous(df, ["host"], "ts", {"before": "id"}, ["id"], hot_rows=hot_rows)
    want, last = {}, {}
    for h, s, i in sorted((h, s, i) for i, (h, s) in enumerate(points)):
        want[i] = last.get(h)
        last[h] = i
    assert {r.id: r.before for r in got.collect()} == want


def test_rows_without_time_come_first(spark):
    rows = [("h", None, 1), ("h", at(0), 2)]
    df = frame(spark, rows, "host string, ts timestamp_ntz, id bigint")
    for hot_rows in (1, 100):
        got = with_previous(df, ["host"], "ts", {"before": "id"}, ["id"], hot_rows)
        assert {r.id: r.before for r in got.collect()} == {1: None, 2: 1}


@pytest.mark.parametrize("hot_rows", [1, 10**6])
@once
@given(points, st.integers(1, 30))
def test_tail_property(spark, hot_rows, points, n):
    rows = [(h, at(s), i) for i, (h, s) in enumerate(points)]
    df = frame(spark, rows, "host string, ts timestamp_ntz, id bigint")
    by_host = defaultdict(list)
    for i, (h, s) in enumerate(points):
        by_host[h].append((s, i))
    want = {i for listed in by_host.values() for _, i in sorted(listed)[-n:]}
    assert {r.id for r in tail(df, n, seq=["id"], hot_rows=hot_rows).collect()} == want


def test_tail_counts_points_and_since_takes_a_time(spark):
    df = frame(spark, [("h", at(60 * i), i) for i in range(50)], "host string, ts timestamp, id bigint")
    assert tail(df, 50).count() == 50
    assert tail(df, 51).count() == 50
    assert {r.id for r in tail(df, 3).collect()} == {47, 48, 49}
    assert {r.id for r in tail(df, 3, since=F.lit(at(60 * 48)).cast("timestamp")).collect()} == {48, 49}
    assert tail(df.limit(0), 3).count() == 0


def test_latest_breaks_ties_by_sequence(spark):
    df = frame(spark, [("h", at(1), 1), ("h", at(1), 2), ("g", at(0), 3)], "host string, ts timestamp, id bigint")
    assert {r.id for r in latest(df, seq=["id"]).collect()} == {2, 3}


def test_backfill_and_live(spark):
    ddl = "host string, ts timestamp, v int"
    old = frame(spark, [("h", at(0), 1), ("h", at(1), 2)], ddl)
    live = frame(spark, [("h", at(1), 3), ("h", at(2), 4)], ddl)
    assert sorted(r.v for r in backfill_union(old, live).collect()) == [1, 2, 3, 4]
    assert sorted(r.v for r in backfill_union(old, live, n=2).collect()) == [3, 4]
    assert sorted(r.v for r in backfill_union(old, live, dedupe=True).collect()) == [1, 3, 4]


def test_extent_and_trend(spark):
    rows = [("h", at(0), -5.0), ("h", at(10), 50.0), ("h", at(40), 120.0), ("lone", at(0), 1.0)]
    rows += [("same", at(3), 10.0), ("same", at(3), 20.0)]
    df = frame(spark, rows, "host string, ts timestamp, v double")
    ranges = {r.host: r.t_range for r in extent(df).collect()}
    assert ranges == {"h": 40, "lone": 1, "same": 1}
    got = sorted((r.host, r.x, r.v_y) for r in trend(df, ["v"]).collect())
    assert got == [("h", 0.0, 0.0), ("h", 0.25, 0.5), ("h", 1.0, 1.0), ("same", 0.0, 0.1), ("same", 0.0, 0.2)]


def test_sample_takes_the_newest_of_each_tick(spark):
    rows = [("h", at(0), 1, 1), ("h", at(59), 2, 2), ("h", at(59), 3, 3), ("h", at(60), 4, 4)]
    df = frame(spark, rows, "host string, ts timestamp, seq int, v int")
    got = {(r.tick - T0).total_seconds(): r.v for r in sample(df, "1 minute", ["v"], seq=["seq"]).collect()}
    assert got == {0.0: 3, 60.0: 4}


def test_session_goes_on_over_exactly_the_gap(spark):
    minutes = [0, 30, 60, 90 + 1 / 60]
    df = frame(spark, [("h", at(60 * m)) for m in minutes], "host string, ts timestamp_ntz")
    got = sorted((r.session_start, r.last_message, r.messages, r.session_end) for r in idle_sessions(df).collect())
    assert got == [
        (at(0), at(3600), 3, at(5400)),
        (at(5401), at(5401), 1, at(7201)),
    ]


@once
@given(points, st.sampled_from([60, 300, 90.5]))
def test_sessions_property(spark, points, gap):
    df = frame(spark, [(h, at(s)) for h, s in points], "host string, ts timestamp_ntz")
    want, open_ = [], {}
    for h, s in sorted(points):
        if h in open_ and s - open_[h][1] <= gap:
            open_[h][1], open_[h][2] = s, open_[h][2] + 1
        else:
            open_[h] = [s, s, 1]
            want.append((h, open_[h]))
    want = sorted((h, at(a), at(b), n, at(b + gap)) for h, (a, b, n) in want)
    got = idle_sessions(df, f"{gap} seconds")
    assert sorted((r.host, r.session_start, r.last_message, r.messages, r.session_end) for r in got.collect()) == want


@pytest.mark.parametrize("hot_rows", [8, 10**6])
@once
@given(points, points)
def test_as_of_property(spark, hot_rows, left, right):
    ddl = "host string, ts timestamp_ntz, id bigint"
    known = [(h, s, None if i % 5 == 4 else i) for i, (h, s) in enumerate(right)]
    l = frame(spark, [(h, at(s), i) for i, (h, s) in enumerate(left)], ddl)
    r = frame(
        spark,
        [(h, at(s), i, v) for i, (h, s, v) in enumerate(known)],
        "host string, ts timestamp_ntz, place bigint, ref bigint",
    )
    want = {}
    for i, (h, s) in enumerate(left):
        before = [(t, place, v) for place, (g, t, v) in enumerate(known) if g == h and t <= s]
        want[i] = max(before, key=lambda x: x[:2])[2] if before else None
    got = as_of(l, r, ["ref"], right_seq=["place"], hot_rows=hot_rows)
    assert {row.id: row.ref for row in got.collect()} == want
