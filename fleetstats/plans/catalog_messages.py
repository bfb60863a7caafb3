"""Message envelope and replay over the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetstats.plans.catalog import query
from fleetstats.plans.catalog_series import LATEST_SQL
from fleetstats.plans.staging import session_folder
from fleetstats.plans.stand_ins import SAMPLES, samples
from fleetstats.sources.messages import containers, containers_payload, decode, encode, history
from fleetstats.sources.replay import replay, replay_rows
from fleetstats.sources.snapshots import read_snapshots


def sample_messages(spark, folder):
    """Every event as a message text.

    Clicks are typed snapshots, views are bare ones, purchases are history, signups are container
    lists.  Errors are of an unknown type where ``k`` is even, and cut off mid-way where it is odd.
    """
    rows = samples(spark, folder)
    document = F.struct(
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("timestamp"),
        F.struct(F.col("host").cast("string").alias("hostname"), F.col("event_id").alias("uptime")).alias("system"),
        F.struct(F.col("value").alias("avgUsage")).alias("cpu"),
        F.struct(F.col("k").cast("double").alias("usedPercent")).alias("memory"),
    )
    point = F.array(
        F.struct(
            F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"),
            F.col("value").alias("c"),
            F.col("k").cast("double").alias("m"),
        )
    )
    container = F.array(
        F.struct(
            F.col("event_id").cast("string").alias("id"),
            F.col("name"),
            F.lit("running").alias("state"),
            F.col("value").alias("cpuPct"),
            F.col("k").alias("memUsage"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"),
        )
    )
    typed = encode(rows, "snapshot", document, "as_snapshot")
    typed = encode(typed, "history", point, "as_history")
    typed = encode(typed, "docker", container, "as_containers")
    typed = encode(typed, "weather", document, "as_other")
    kind, even = F.col("name"), F.col("k") % 2 == 0
    text = (
        F.when(kind == "click", F.col("as_snapshot"))
        .when(kind == "view", F.to_json(document))
        .when(kind == "purchase", F.col("as_history"))
        .when(kind == "signup", F.col("as_containers"))
        .when(even, F.col("as_other"))
        .otherwise(F.concat(F.lit('{"type":"snapshot","payload":{'), F.col("event_id").cast("string")))
    )
    return typed.select(
        F.col("host").cast("string").alias("host"), F.col("ts").cast("timestamp").alias("ts"), "event_id", text.alias("value")
    )


ROUTES = """CASE name WHEN 'click' THEN 'snapshot' WHEN 'view' THEN 'snapshot' WHEN 'purchase' THEN 'history'
    WHEN 'signup' THEN 'docker' ELSE CASE WHEN k % 2 = 0 THEN 'unknown' ELSE 'corrupt' END END"""


@query(
    "envelope_roundtrip",
    f"""SELECT event_id, {ROUTES} AS route, CASE WHEN name IN ('click', 'view') THEN value END AS cpu_avg,
      CASE WHEN name IN ('click', 'view') THEN host END AS host,
      CASE WHEN name = 'signup' THEN k WHEN name = 'purchase' THEN k END AS reading FROM {SAMPLES}""",
)
def envelope_roundtrip(spark, folder):
    decoded = decode(sample_messages(spark, folder))

    def found(path, kind):
        return F.try_variant_get("body", path, kind)

    is_snapshot = F.col("route") == "snapshot"
    reading = F.coalesce(found("$[0].memUsage", "bigint"), found("$[0].m", "double").cast("bigint"))
    return decoded.select(
        "event_id",
        "route",
        F.when(is_snapshot, found("$.cpu.avgUsage", "double")).alias("cpu_avg"),
        F.when(is_snapshot, found("$.system.hostname", "string").cast("bigint")).alias("host"),
        F.when(~is_snapshot, reading).alias("reading"),
    )


@query(
    "containers_message",
    f"""SELECT CAST(host AS VARCHAR) AS host, ts, CAST(event_id AS VARCHAR) AS id, name, value AS cpu_pct, k AS mem_usage,
      date_trunc('second', ts)::TIMESTAMP AS created FROM {SAMPLES}""",
)
def containers_message(spark, folder):
    """Landed containers made of the events, as messages of one list per host and tick, decoded again."""
    landed = samples(spark, folder).select(
        F.col("host").cast("string").alias("host"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").cast("string").alias("id"), "name", F.lit("image").alias("image"), F.lit("running").alias("state"),
        F.lit("Up").alias("status"), F.col("value").alias("cpu_pct"), F.col("k").alias("mem_usage"), F.lit(None).cast("bigint").alias("mem_limit"),
        F.col("ts").cast("timestamp").alias("created"),
    )
    decoded = containers(decode(encode(containers_payload(landed), "docker", "payload")))
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("ts", "created")}
    return decoded.select("host", "ts", "id", "name", "cpu_pct", "mem_usage", "created").withColumns(times)


@query(
    "snapshot_source",
    f"""SELECT CAST(host AS VARCHAR) AS host, date_trunc('millisecond', ts)::TIMESTAMP AS ts, event_id AS uptime,
      value AS cpu_avg, CAST(k AS DOUBLE) AS mem_percent FROM {SAMPLES} WHERE name = 'view'""",
)
def snapshot_source(spark, folder):
    """Views as landed lines of bare snapshots, read through the reader."""
    lines = session_folder(spark, "snapshot-lines") + "/lines"
    sample_messages(spark, folder).join(
        samples(spark, folder).where("name = 'view'").select("event_id"), "event_id", "left_semi"
    ).select("value").write.text(lines)
    return read_snapshots(spark, lines, "json").select(
        "host", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("system.uptime").alias("uptime"),
        F.col("cpu.avgUsage").alias("cpu_avg"), F.col("memory.usedPercent").alias("mem_percent"),
    )


_NEWEST_5 = "row_number() OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC) <= 5"


@query(
    "replay",
    f"""SELECT *, 'snapshot' AS part, 0 AS place FROM ({LATEST_SQL})
    UNION ALL SELECT *, 'history', 1 FROM (SELECT * FROM {SAMPLES} QUALIFY {_NEWEST_5})""",
)
def replay_(spark, folder):
    rows = samples(spark, folder)
    return replay_rows(rows, rows, 5, seq=["event_id"])


@query(
    "replay_messages",
    f"""SELECT host, date_trunc('second', ts)::TIMESTAMP AS ts, value AS cpu_avg, CAST(k AS DOUBLE) AS mem_percent
    FROM {SAMPLES} QUALIFY {_NEWEST_5}""",
)
def replay_messages(spark, folder):
    """The history messages of a replay, decoded again."""
    rows = samples(spark, folder)
    points = rows.select(
        "host", "ts", F.col("value").alias("cpu_avg"), F.col("k").cast("double").alias("mem_percent")
    )
    sent = replay(rows, points, n=5, payload=F.struct("name", "value"))
    received = history(decode(sent))
    return received.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
