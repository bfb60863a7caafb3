from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetstats.functions import labels, numbers, times

once = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def exact_fixed(x, digits):
    """Rounding of the exact binary value, ties away from zero."""
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def exact_bytes(b):
    power = 0
    while power < 4 and b >= 1024 ** (power + 1):
        power += 1
    return f"{exact_fixed(b / 1024**power, 1 if power else 0)} {('B', 'KB', 'MB', 'GB', 'TB')[power]}"


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_to_fixed_rounds_the_exact_value(values, digits):
    xs = [0.0, 0.5, 1.5, 2.5, 0.05, 0.15, 0.25, 0.35, 0.75, 1.005, 0.125, 0.375, 99.95, 100.0, 1e15 + 0.5]
    got = values(numbers.to_fixed("x", digits), [(x,) for x in xs], "x double")
    assert got == [exact_fixed(x, digits) for x in xs]


def test_to_fixed_of_negative_and_missing(values):
    got = values(numbers.to_fixed("x", 1), [(-0.25,), (-0.04,), (None,)], "x double")
    assert got == ["-0.3", "-0.0", None]


@once
@given(st.lists(st.floats(0, 1e12, allow_nan=False), min_size=1, max_size=50))
def test_to_fixed_property(values, xs):
    for digits in (0, 1, 2):
        got = values(numbers.to_fixed("x", digits), [(x,) for x in xs], "x double")
        assert got == [exact_fixed(x, digits) for x in xs]


def test_fmt_bytes_ladder(values):
    k = 1024
    rows = {
        0: "0 B",
        1: "1 B",
        1023: "1023 B",
        k: "1.0 KB",
        1536: "1.5 KB",
        k**2 - 1: "1024.0 KB",
        k**2: "1.0 MB",
        k**3: "1.0 GB",
        k**4: "1.0 TB",
        k**4 - 1: "1024.0 GB",
        k**5: "1024.0 TB",
        2**63 - 1: "8388608.0 TB",
    }
    assert values(numbers.fmt_bytes("b"), [(b,) for b in rows], "b bigint") == list(rows.values())
    assert values(numbers.fmt_bytes("b"), [(None,)], "b bigint") == [None]


@once
@given(st.lists(st.integers(0, 2**60), min_size=1, max_size=50))
def test_fmt_bytes_property(values, bs):
    got = values(numbers.fmt_bytes("b"), [(b,) for b in bs], "b bigint")
    assert got == [exact_bytes(b) for b in bs]


def test_fmt_rate_ladder(values):
    rows = {
        -5.0: "0 B/s",
        0.0: "0 B/s",
        0.4: "0 B/s",
        0.5: "1 B/s",
        1023.4: "1023 B/s",
        1023.6: "1024 B/s",
        1024.0: "1.0 KB/s",
        1024.0**2: "1.0 MB/s",
        1024.0**3: "1024.0 MB/s",
    }
    assert values(numbers.fmt_rate("r"), [(r,) for r in rows], "r double") == list(rows.values())


def test_mem_text(values):
    assert values(numbers.mem_text("u", "t"), [(512, 2048)], "u bigint, t bigint") == ["512 B / 2.0 KB"]


def test_fmt_uptime(values):
    rows = {0: "0m", 59: "0m", 60: "1m", 3600: "1h 0m", 86400: "1d 0m", 90061: "1d 1h 1m", 86399: "23h 59m"}
    assert values(times.fmt_uptime("s"), [(s,) for s in rows], "s bigint") == list(rows.values())


def test_fmt_datetime(values):
    texts = ["2024-03-01T04:05:06Z", "2024-03-01 04:05:06.789", "", "soon", None]
    got = values(times.fmt_datetime("t"), [(t,) for t in texts], "t string")
    assert got == ["2024-03-01 04:05:06", "2024-03-01 04:05:06", "-", "-", "-"]
    at = datetime(2024, 3, 1, 4, 5, 6)
    assert values(times.fmt_datetime("t"), [(at,)], "t timestamp_ntz") == ["2024-03-01 04:05:06"]


def test_epoch_texts_and_conversions(values):
    assert values(times.fmt_hhmm("s"), [(3660,)], "s bigint") == ["01:01"]
    assert values(times.rfc3339("s"), [(0,)], "s bigint") == ["1970-01-01T00:00:00Z"]
    assert values(times.ms_to_s("m"), [(1999,), (-1,)], "m bigint") == [1, -1]
    assert values(times.s_to_ms("s"), [(2,)], "s bigint") == [2000]
    back = times.ts_to_ms(times.ms_to_ts("m"))
    assert values(back, [(1704067207179,)], "m bigint") == [1704067207179]


def test_percent_classes_include_the_threshold(values):
    rows = [(69.99,), (70.0,), (89.99,), (90.0,)]
    assert values(labels.pct_class("p"), rows, "p double") == ["", "warn", "warn", "crit"]
    assert values(labels.pct_color("p"), rows, "p double") == ["green", "yellow", "yellow", "red"]


def test_process_colors_exclude_the_threshold(values):
    rows = [(20.0,), (20.1,), (50.0,), (50.1,)]
    assert values(labels.proc_color("p"), rows, "p double") == ["", "yellow", "yellow", "red"]


def test_load_color_is_per_thread(values):
    rows = [(2.8, 4), (2.79, 4), (4.0, 4), (0.7, 0), (1.0, None)]
    got = values(labels.load_color("l", "n"), rows, "l double, n int")
    assert got == ["yellow", "green", "red", "yellow", "red"]


def test_status_labels(values):
    known = list(labels.STATUS_LABELS.items())
    rows = known + [("W", "W"), ("", "-"), (None, "-")]
    assert values(labels.status_label("s"), [(s,) for s, _ in rows], "s string") == [t for _, t in rows]


def test_state_badge(values):
    states = [("running",), ("exited",), ("paused",), ("dead",), (None,)]
    assert values(labels.state_badge("s"), states, "s string") == ["running", "exited", "paused", "", ""]
    got = values(labels.container_state("s"), [("dead",), ("",), (None,)], "s string")
    assert got == ["dead", "unknown", "unknown"]


def test_container_name_strips_one_slash(values):
    rows = [(["/web", "/x"],), (["//web"],), (["web"],), ([],), (None,)]
    got = values(labels.container_name("n"), rows, "n array<string>")
    assert got == ["web", "/web", "web", "", ""]


def test_platform_keeps_the_gap(values):
    got = values(labels.platform("a", "b"), [("debian", "12"), (None, None)], "a string, b string")
    assert got == ["debian 12", " "]


def test_dash(values):
    assert values(labels.dash("t"), [("a",), ("",), (None,)], "t string") == ["a", "-", "-"]
    assert values(labels.dash(F.lit("x")), [("a",)], "t string") == ["x"]
