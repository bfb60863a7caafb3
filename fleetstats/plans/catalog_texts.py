"""Report columns over the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetstats.functions import labels, numbers, times
from fleetstats.operators.flatten import host_overview
from fleetstats.operators.severity import severity_rollup
from fleetstats.plans.catalog import query, table
from fleetstats.plans.stand_ins import (
    COLORS,
    PCT_CLASS,
    PROC_COLORS,
    SAMPLES,
    samples,
    sql_bytes,
    sql_class,
    sql_fixed,
    sql_rate,
)

_READINGS = f"SELECT host, event_id, value, k FROM {SAMPLES}"


def _readings(spark, folder):
    return samples(spark, folder).select("host", "event_id", "value", "k")


@query(
    "pct_class",
    f"""SELECT *, {sql_class('value', PCT_CLASS, 90, 70)} AS bar,
      {sql_class('value', COLORS, 90, 70)} AS color FROM ({_READINGS})""",
)
def pct_class(spark, folder):
    return _readings(spark, folder).withColumns(
        {"bar": labels.pct_class("value"), "color": labels.pct_color("value")}
    )


_PER_THREAD = "(value / CAST(CASE WHEN k = 0 THEN 1 ELSE k END AS DOUBLE))"


@query(
    "load_color",
    f"SELECT *, {sql_class(_PER_THREAD, COLORS, 1.0, 0.7)} AS color FROM ({_READINGS})",
)
def load_color(spark, folder):
    return _readings(spark, folder).withColumn("color", labels.load_color("value", "k"))


@query(
    "proc_color",
    f"SELECT *, {sql_class('value', PROC_COLORS, 50, 20, '>')} AS color FROM ({_READINGS})",
)
def proc_color(spark, folder):
    return _readings(spark, folder).withColumn("color", labels.proc_color("value"))


@query(
    "severity_rollup",
    f"""SELECT host, severity, count(*) AS readings, kind FROM (
      SELECT host, {sql_class('value', COLORS, 90, 70)} AS severity, 'percent' AS kind FROM ({_READINGS})
      UNION ALL
      SELECT host, {sql_class(_PER_THREAD, COLORS, 1.0, 0.7)}, 'load' FROM ({_READINGS})
      UNION ALL
      SELECT host, {sql_class('value', PROC_COLORS, 50, 20, '>')}, 'process' FROM ({_READINGS}))
    GROUP BY ALL""",
)
def severity_rollup_(spark, folder):
    kinds = {
        "percent": labels.pct_color("value"),
        "load": labels.load_color("value", "k"),
        "process": labels.proc_color("value"),
    }
    return severity_rollup(_readings(spark, folder), kinds)


@query(
    "status_label",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
      CASE l_returnflag WHEN 'R' THEN 'RUN' WHEN 'A' THEN '-' ELSE l_returnflag END AS flag_label,
      CASE l_linenumber WHEN 1 THEN 'SLP' WHEN 2 THEN 'DSK' WHEN 3 THEN 'ZMB' WHEN 4 THEN 'STP'
        WHEN 5 THEN 'IDL' WHEN 6 THEN 'RUN' ELSE '-' END AS line_label
    FROM lineitem""",
)
def status_label(spark, folder):
    words = F.array(*[F.lit(w) for w in ("S", "D", "zombie", "stop", "idle", "running", "")])
    rows = table(spark, folder, "lineitem")
    return rows.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        labels.status_label(F.nullif("l_returnflag", F.lit("A"))).alias("flag_label"),
        labels.status_label(F.get(words, F.col("l_linenumber") - 1)).alias("line_label"),
    )


@query(
    "state_badge",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'exited' ELSE '' END AS badge,
      CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'exited' ELSE 'unknown' END AS state
    FROM orders""",
)
def state_badge(spark, folder):
    state = F.when(F.col("o_orderstatus") == "F", "running").when(F.col("o_orderstatus") == "O", "exited")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        labels.state_badge(state).alias("badge"),
        labels.container_state(state).alias("state"),
    )


@query(
    "container_name",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS name FROM customer""",
)
def container_name(spark, folder):
    names = F.when(
        F.col("c_acctbal") >= 0, F.array(F.concat(F.lit("/"), "c_name"), F.lit("/alias"))
    ).otherwise(F.array().cast("array<string>"))
    return table(spark, folder, "customer").select(
        "c_custkey", labels.container_name(names).alias("name")
    )


# An amount of money times 1024**(priority - 1) is a byte count somewhere between B and TB.
_AMOUNT = """(SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(
    floor(o_totalprice) * power(1024, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) AS BIGINT) END
    AS amount FROM orders)"""


def _amounts(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", F.expr(
        """CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(floor(o_totalprice)
        * power(1024, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1) AS BIGINT) END"""
    ).alias("amount"))


@query("fmt_bytes", f"SELECT *, {sql_bytes('amount')} AS shown FROM {_AMOUNT}")
def fmt_bytes(spark, folder):
    return _amounts(spark, folder).withColumn("shown", numbers.fmt_bytes("amount"))


@query("fmt_rate", f"SELECT *, {sql_rate('(amount / CAST(1000 AS DOUBLE) - 1)')} AS shown FROM {_AMOUNT}")
def fmt_rate(spark, folder):
    return _amounts(spark, folder).withColumn(
        "shown", numbers.fmt_rate(F.col("amount").cast("double") / 1000.0 - 1.0)
    )


@query(
    "mem_text",
    f"SELECT *, {sql_bytes('amount')} || ' / ' || {sql_bytes('(amount * 3)')} AS shown FROM {_AMOUNT}",
)
def mem_text(spark, folder):
    return _amounts(spark, folder).withColumn(
        "shown", numbers.mem_text("amount", F.col("amount") * 3)
    )


@query(
    "to_fixed",
    f"""SELECT event_id, value, {sql_fixed('value', 0)} AS fixed0, {sql_fixed('value', 1)} AS fixed1,
      {sql_fixed('value', 2)} AS fixed2, {sql_fixed('(value / 8 - 10)', 2)} AS moved2 FROM events""",
)
def to_fixed(spark, folder):
    fixed = {f"fixed{d}": numbers.to_fixed("value", d) for d in (0, 1, 2)}
    fixed["moved2"] = numbers.to_fixed(F.col("value") / 8 - 10, 2)
    return table(spark, folder, "events").select("event_id", "value").withColumns(fixed)


@query(
    "fmt_uptime",
    """SELECT o_orderkey, seconds, CASE WHEN seconds >= 86400 THEN seconds // 86400 || 'd ' ELSE '' END
      || CASE WHEN seconds % 86400 >= 3600 THEN (seconds % 86400) // 3600 || 'h ' ELSE '' END
      || (seconds % 3600) // 60 || 'm' AS shown
    FROM (SELECT o_orderkey, o_orderkey * 977 AS seconds FROM orders)""",
)
def fmt_uptime(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderkey") * 977).alias("seconds")
    )
    return rows.withColumn("shown", times.fmt_uptime("seconds"))


@query(
    "fmt_datetime",
    """SELECT event_id, CASE WHEN event_type IN ('error', 'view', 'signup') THEN '-'
      ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS shown, strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_time
    FROM events""",
)
def fmt_datetime(spark, folder):
    text = (
        F.when(F.col("event_type") == "view", "")
        .when(F.col("event_type") == "signup", "not a time")
        .when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    )
    return table(spark, folder, "events").select(
        "event_id",
        times.fmt_datetime(text).alias("shown"),
        times.fmt_datetime("ts").alias("from_time"),
    )


_SECONDS = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"


@query("fmt_hhmm", "SELECT event_id, strftime(ts, '%H:%M') AS shown FROM events")
def fmt_hhmm(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", times.fmt_hhmm(times.ts_to_s("ts")).alias("shown")
    )


@query("rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS shown FROM events")
def rfc3339(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", times.rfc3339(times.ts_to_s("ts")).alias("shown")
    )


@query(
    "epoch_conv",
    f"""SELECT event_id, epoch_us(ts) // 1000 AS millis, {_SECONDS} AS seconds,
      {_SECONDS} * 1000 AS whole_millis, date_trunc('millisecond', ts)::TIMESTAMP AS from_millis,
      date_trunc('second', ts)::TIMESTAMP AS from_seconds FROM events""",
)
def epoch_conv(spark, folder):
    millis = table(spark, folder, "events").select("event_id", times.ts_to_ms("ts").alias("millis"))
    return millis.select(
        "event_id",
        "millis",
        times.ms_to_s("millis").alias("seconds"),
        times.s_to_ms(times.ms_to_s("millis")).alias("whole_millis"),
        times.ms_to_ts("millis").cast("timestamp_ntz").alias("from_millis"),
        times.s_to_ts(times.ms_to_s("millis")).cast("timestamp_ntz").alias("from_seconds"),
    )


@query(
    "platform_text",
    "SELECT c_custkey, c_mktsegment || ' ' || n_name AS platform FROM customer JOIN nation ON n_nationkey = c_nationkey",
)
def platform_text(spark, folder):
    nation = table(spark, folder, "nation")
    rows = table(spark, folder, "customer").join(
        nation, F.col("n_nationkey") == F.col("c_nationkey")
    )
    return rows.select("c_custkey", labels.platform("c_mktsegment", "n_name").alias("platform"))


_SIZE = "CAST(round(abs(c_acctbal) * 100) AS BIGINT)"
_LOADS = ("value / 300", "value / 600", "value / 900")
_CUSTOMER = f"""(SELECT *, {_SIZE} AS size, abs(c_acctbal) / 100 AS value,
    CASE WHEN c_nationkey = 0 THEN 1 ELSE c_nationkey END AS per FROM customer)"""


def _sql_load(number: int, expression: str) -> str:
    per = f"({expression} / per)"
    return f"""{sql_fixed(f'({expression})', 2)} AS load{number}_text,
      {sql_class(per, COLORS, 1.0, 0.7)} AS load{number}_color"""


@query(
    "host_overview",
    f"""SELECT c_custkey AS host, c_name AS hostname, c_mktsegment || ' / ' || c_nationkey || ' / ' AS platform_text,
      'up ' || CASE WHEN size >= 86400 THEN size // 86400 || 'd ' ELSE '' END
      || CASE WHEN size % 86400 >= 3600 THEN (size % 86400) // 3600 || 'h ' ELSE '' END
      || (size % 3600) // 60 || 'm' AS uptime_text, 'v1' AS runtime_version, '-' AS cpu_model,
      c_nationkey // 2 || 'C/' || c_nationkey || 'T' AS cpu_text,
      {sql_fixed('value', 1)} AS cpu_avg_text, {sql_class('value', COLORS, 90, 70)} AS cpu_color,
      {sql_fixed('value', 1)} AS mem_percent_text, {sql_class('value', COLORS, 90, 70)} AS mem_color,
      {sql_class('value', PCT_CLASS, 90, 70)} AS mem_class,
      {sql_bytes('size')} AS mem_used, {sql_bytes('(size * 1024)')} AS mem_free,
      {sql_bytes('(size * 1025)')} AS mem_total,
      {sql_bytes('size')} || ' / ' || {sql_bytes('(size * 1025)')} AS mem_text,
      CASE WHEN c_acctbal > 0 THEN {sql_bytes('(size // 2)')} END AS swap_used,
      CASE WHEN c_acctbal > 0 THEN {sql_bytes('size')} END AS swap_total,
      CASE WHEN c_acctbal > 0 THEN {sql_fixed('value', 0)} END AS swap_percent,
      CASE WHEN c_acctbal > 0 THEN {sql_class('value', PCT_CLASS, 90, 70)} END AS swap_class,
      {', '.join(_sql_load(n, e) for n, e in zip((1, 5, 15), _LOADS))}
    FROM {_CUSTOMER}""",
)
def host_overview_(spark, folder):
    rows = table(spark, folder, "customer").withColumns(
        {"size": F.expr(_SIZE), "value": F.expr("abs(c_acctbal) / 100")}
    )
    nested = rows.selectExpr(
        "c_custkey AS host",
        """named_struct('hostname', c_name, 'platform', c_mktsegment, 'kernel',
            CAST(c_nationkey AS STRING), 'arch', CAST(NULL AS STRING), 'uptime', size,
            'goVersion', 'v1') AS system""",
        """named_struct('model', '', 'cores', c_nationkey DIV 2, 'threads', c_nationkey,
            'avgUsage', value) AS cpu""",
        """named_struct('total', size * 1025, 'used', size, 'available', size * 1024,
            'usedPercent', value, 'swapTotal', CASE WHEN c_acctbal > 0 THEN size ELSE 0 END,
            'swapUsed', size DIV 2, 'swapPercent', value) AS memory""",
        "named_struct('load1', value / 300, 'load5', value / 600, 'load15', value / 900) AS load",
    )
    return host_overview(nested, ["host"])
