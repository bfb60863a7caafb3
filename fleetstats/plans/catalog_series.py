"""Rates, history, latest rows, ticks, sessions and as-of alignment over the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetstats.operators.asof import as_of
from fleetstats.operators.flatten import exclude_ifaces
from fleetstats.operators.rates import counter_rate
from fleetstats.operators.series import (
    backfill_union,
    extent,
    history_points,
    latest,
    sample,
    tail,
    trend,
)
from fleetstats.operators.sessions import idle_sessions
from fleetstats.plans.carry import counter_rate_run
from fleetstats.plans.catalog import query
from fleetstats.plans.staging import session_folder
from fleetstats.plans.stand_ins import LOOPBACK, SAMPLES, samples

_RATE = """CASE WHEN pk IS NULL OR k < pk THEN CAST(0 AS DOUBLE)
    ELSE CAST(k - pk AS DOUBLE) / CASE WHEN epoch_us(ts) > epoch_us(since)
        THEN (epoch_us(ts) - epoch_us(since)) / CAST(1000000 AS DOUBLE) ELSE 1 END END"""

COUNTER_RATE_SQL = f"""
WITH p AS (
  SELECT *, lag(k) OVER w AS pk, lag(ts) OVER w AS since
  FROM {SAMPLES} WHERE name <> '{LOOPBACK}'
  WINDOW w AS (PARTITION BY host, name ORDER BY ts, event_id))
SELECT host, name, ts, event_id, k, {_RATE} AS k_rate, coalesce(k < pk, false) AS reset FROM p
"""


@query("counter_rate_key", COUNTER_RATE_SQL)
def counter_rate_key(spark, folder):
    counted = exclude_ifaces(samples(spark, folder), (LOOPBACK,)).drop("value")
    return counter_rate(counted, ["k"], seq=["event_id"])


@query("counter_rate_runs", COUNTER_RATE_SQL)
def counter_rate_runs(spark, folder):
    """Three runs with the last samples kept in a store between them; the second is run again when the third is done."""
    counted = exclude_ifaces(samples(spark, folder), (LOOPBACK,)).drop("value")
    store = session_folder(spark, "carry")
    spans = {"a": "ts < TIMESTAMP_NTZ'2024-01-10'", "b": "ts >= TIMESTAMP_NTZ'2024-01-10' AND ts < TIMESTAMP_NTZ'2024-01-20'",
             "c": "ts >= TIMESTAMP_NTZ'2024-01-20'"}
    rates = {run: counter_rate_run(counted.where(spans[run]), store, run, ["k"], seq=["event_id"]) for run in ("a", "b", "c", "b")}
    return rates["a"].unionByName(rates["b"]).unionByName(rates["c"])


@query("counter_rate_carried", COUNTER_RATE_SQL)
def counter_rate_carried(spark, folder):
    """Two runs over halves of the time; the second carries the last sample of each key of the first."""
    counted = exclude_ifaces(samples(spark, folder), (LOOPBACK,)).drop("value")
    early, later = (counted.where(f"ts {sign} TIMESTAMP_NTZ'2024-01-15'") for sign in ("<", ">="))
    carried = latest(early, ["host", "name"], seq=["event_id"])
    first = counter_rate(early, ["k"], seq=["event_id"])
    return first.unionByName(counter_rate(later, ["k"], seq=["event_id"], carried=carried))


@query(
    "counter_rate_tick",
    f"""
WITH t AS (
  SELECT host, ts, lag(ts) OVER (PARTITION BY host ORDER BY ts) AS since
  FROM (SELECT DISTINCT host, ts FROM {SAMPLES})),
p AS (
  SELECT *, lag(k) OVER (PARTITION BY host, name ORDER BY ts, event_id) AS pk
  FROM {SAMPLES} WHERE name <> '{LOOPBACK}')
SELECT host, name, ts, event_id, k, {_RATE} AS k_rate, coalesce(k < pk, false) AS reset
FROM p JOIN t USING (host, ts)
""",
)
def counter_rate_tick(spark, folder):
    all_ticks = samples(spark, folder)
    counted = exclude_ifaces(all_ticks, (LOOPBACK,)).drop("value")
    return counter_rate(counted, ["k"], seq=["event_id"], elapsed="tick", ticks=all_ticks)


def _points(spark, folder):
    nested = samples(spark, folder).select(
        "host",
        "ts",
        F.struct(F.col("value").alias("avgUsage")).alias("cpu"),
        F.struct(F.col("k").cast("double").alias("usedPercent")).alias("memory"),
    )
    return history_points(nested)


_POINTS = f"(SELECT host, ts, value AS cpu_avg, CAST(k AS DOUBLE) AS mem_percent FROM {SAMPLES})"


@query("history_points", f"SELECT * FROM {_POINTS}")
def history_points_(spark, folder):
    return _points(spark, folder)


def _tail_sql(n: int) -> str:
    return f"""SELECT * FROM {_POINTS}
        QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC) <= {n}"""


@query("history_tail", _tail_sql(20))
def history_tail(spark, folder):
    return tail(_points(spark, folder), 20)


@query("history_tail_default", _tail_sql(3600))
def history_tail_default(spark, folder):
    return tail(_points(spark, folder))


_LIVE_TYPES = ("click", "purchase")


def backfill_and_live(spark, folder):
    points = samples(spark, folder).select(
        "host", "ts", "event_id", F.col("value").alias("cpu_avg"), "name"
    )
    backfill = points.withColumn("origin", F.lit("backfill"))
    live = points.where(F.col("name").isin(*_LIVE_TYPES)).withColumn("origin", F.lit("live"))
    return backfill.drop("name"), live.drop("name")


_BOTH = f"""(
  SELECT host, ts, event_id, value AS cpu_avg, 'backfill' AS origin, 0 AS live FROM {SAMPLES}
  UNION ALL
  SELECT host, ts, event_id, value, 'live', 1 FROM {SAMPLES} WHERE name IN {_LIVE_TYPES})"""
_NEWEST_20 = "row_number() OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC, live DESC) <= 20"


@query(
    "backfill_union",
    f"SELECT host, ts, event_id, cpu_avg, origin FROM {_BOTH} QUALIFY {_NEWEST_20}",
)
def backfill_union_(spark, folder):
    return backfill_union(*backfill_and_live(spark, folder), n=20, seq=["event_id"])


BACKFILL_DEDUPE_SQL = f"""SELECT host, ts, event_id, cpu_avg, origin FROM (
      SELECT * FROM {_BOTH}
      QUALIFY row_number() OVER (PARTITION BY host, ts ORDER BY live DESC, event_id DESC) = 1)
    QUALIFY {_NEWEST_20}"""


@query("backfill_union_dedupe", BACKFILL_DEDUPE_SQL)
def backfill_union_dedupe(spark, folder):
    return backfill_union(*backfill_and_live(spark, folder), n=20, dedupe=True, seq=["event_id"])


LATEST_SQL = f"""SELECT * FROM {SAMPLES}
    QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC) = 1"""


@query("host_latest", LATEST_SQL)
def host_latest(spark, folder):
    return latest(samples(spark, folder), seq=["event_id"])


_EXTENT = f"""(SELECT host, min(t) AS t_min, max(t) AS t_max, count(*) AS points,
    greatest(max(t) - min(t), 1) AS t_range
    FROM (SELECT host, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t FROM {_POINTS})
    GROUP BY host)"""


@query("series_extent", f"SELECT * FROM {_EXTENT}")
def series_extent(spark, folder):
    return extent(_points(spark, folder))


@query(
    "trend_series",
    f"""SELECT p.host, p.ts, p.cpu_avg, p.mem_percent,
      CAST(CAST(floor(epoch_us(p.ts) / 1000000) AS BIGINT) - e.t_min AS DOUBLE)
        / CAST(e.t_range AS DOUBLE) AS x,
      CASE WHEN p.cpu_avg IS NOT NULL THEN greatest(0, least(100, p.cpu_avg)) / CAST(100 AS DOUBLE) END AS cpu_avg_y,
      CASE WHEN p.mem_percent IS NOT NULL THEN greatest(0, least(100, p.mem_percent)) / CAST(100 AS DOUBLE) END
        AS mem_percent_y
    FROM {_POINTS} p JOIN {_EXTENT} e USING (host) WHERE e.points >= 2""",
)
def trend_series(spark, folder):
    return trend(_points(spark, folder))


TICK_SQL = f"""SELECT host, time_bucket(INTERVAL '1 hour', ts) AS tick,
    arg_max(value, ts) AS value, arg_max(k, ts) AS k FROM {SAMPLES} GROUP BY ALL"""


@query("tick_sample", TICK_SQL)
def tick_sample(spark, folder):
    return sample(samples(spark, folder), "1 hour", ["value", "k"])


SESSIONS_SQL = f"""
WITH f AS (
  SELECT host, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 THEN 0 ELSE 1 END
    AS opens FROM {SAMPLES} WINDOW w AS (PARTITION BY host ORDER BY ts)),
n AS (
  SELECT host, ts, sum(opens) OVER (PARTITION BY host ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT host, min(ts) AS session_start, max(ts) AS last_message, count(*) AS messages,
  max(ts) + INTERVAL '30 minutes' AS session_end FROM n GROUP BY host, s
"""


@query("idle_sessions", SESSIONS_SQL)
def idle_sessions_(spark, folder):
    return idle_sessions(samples(spark, folder))


AS_OF_SQL = f"""SELECT a.host, a.ts, a.event_id, b.ref_id, b.ref_value
    FROM (SELECT * FROM {SAMPLES} WHERE name = 'view') a
    ASOF LEFT JOIN (
      SELECT host, ts, event_id AS ref_id, value AS ref_value FROM {SAMPLES} WHERE name = 'error') b
    ON a.host = b.host AND a.ts >= b.ts"""


def as_of_sides(spark, folder):
    """Left rows, right rows, the columns to take and what orders equal times."""
    rows = samples(spark, folder)
    left = rows.where("name = 'view'").select("host", "ts", "event_id")
    right = rows.where("name = 'error'").select(
        "host", "ts", F.col("event_id").alias("ref_id"), F.col("value").alias("ref_value")
    )
    return left, right, ["ref_id", "ref_value"], {"right_seq": ["ref_id"]}


@query("as_of_containers", AS_OF_SQL)
def as_of_containers(spark, folder):
    left, right, values, more = as_of_sides(spark, folder)
    return as_of(left, right, values, **more)


@query(
    "exclude_ifaces",
    f"""SELECT host, ts, event_id, CASE name WHEN 'view' THEN 'lo' WHEN 'click' THEN 'lo0' ELSE name END
    AS name FROM {SAMPLES} WHERE name <> 'view'""",
)
def exclude_ifaces_(spark, folder):
    name = F.when(F.col("name") == "view", "lo").when(F.col("name") == "click", "lo0")
    rows = samples(spark, folder).withColumn("name", name.otherwise(F.col("name")))
    return exclude_ifaces(rows).select("host", "ts", "event_id", "name")
