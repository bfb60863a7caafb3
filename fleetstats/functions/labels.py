"""Threshold classes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, class names and status labels of the reports.
PERCENT_CRITICAL, PERCENT_WARNING = 90, 70  # reached or passed
LOAD_RED, LOAD_YELLOW = 1.0, 0.7  # load per thread, reached or passed
PROCESS_RED, PROCESS_YELLOW = 50, 20  # passed, not merely reached
STATUS_LABELS = {
    "R": "RUN",
    "S": "SLP",
    "D": "DSK",
    "Z": "ZMB",
    "T": "STP",
    "I": "IDL",
    "running": "RUN",
    "sleep": "SLP",
    "idle": "IDL",
    "stop": "STP",
    "zombie": "ZMB",
}
BADGE_STATES = ("running", "exited", "paused")


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct_class(percent: str | Column) -> Column:
    p = _column(percent)
    return (
        F.when(p >= PERCENT_CRITICAL, "crit").when(p >= PERCENT_WARNING, "warn").otherwise("")
    )


def pct_color(percent: str | Column) -> Column:
    p = _column(percent)
    return (
        F.when(p >= PERCENT_CRITICAL, "red").when(p >= PERCENT_WARNING, "yellow").otherwise("green")
    )


def load_color(load: str | Column, threads: str | Column) -> Column:
    """Colour of the load per thread; a missing or zero thread count counts as one."""
    per_thread = _column(load) / F.coalesce(F.nullif(_column(threads), F.lit(0)), F.lit(1))
    return (
        F.when(per_thread >= LOAD_RED, "red").when(per_thread >= LOAD_YELLOW, "yellow").otherwise("green")
    )


def proc_color(percent: str | Column) -> Column:
    p = _column(percent)
    return F.when(p > PROCESS_RED, "red").when(p > PROCESS_YELLOW, "yellow").otherwise("")


def status_label(status: str | Column) -> Column:
    """Short label of a process status; an unknown status stands for itself, a missing one is ``-``."""
    s = _column(status)
    labels = F.create_map(*[F.lit(text) for pair in STATUS_LABELS.items() for text in pair])
    return F.coalesce(F.try_element_at(labels, s), F.nullif(s, F.lit("")), F.lit("-"))


def container_state(state: str | Column) -> Column:
    return F.coalesce(F.nullif(_column(state), F.lit("")), F.lit("unknown"))


def state_badge(state: str | Column) -> Column:
    """Badge of a container state: one of ``BADGE_STATES``, else plain (empty)."""
    s = _column(state)
    return F.when(s.isin(*BADGE_STATES), s).otherwise("")


def container_name(names: str | Column) -> Column:
    """First of a container's names, less one leading slash."""
    return F.regexp_replace(F.coalesce(F.get(_column(names), F.lit(0)), F.lit("")), "^/", "")


def platform(name: str | Column, version: str | Column) -> Column:
    return F.concat(
        F.coalesce(_column(name), F.lit("")), F.lit(" "), F.coalesce(_column(version), F.lit(""))
    )


def dash(text: str | Column) -> Column:
    """The text, or ``-`` where it is missing or empty."""
    return F.coalesce(F.nullif(_column(text), F.lit("")), F.lit("-"))
