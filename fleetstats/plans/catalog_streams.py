"""Streams over the tables at hand, run over what is there and read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetstats.operators.series import latest
from fleetstats.plans.catalog import query, table
from fleetstats.plans.catalog_messages import ROUTES, sample_messages
from fleetstats.plans.catalog_series import COUNTER_RATE_SQL, LATEST_SQL, SESSIONS_SQL, TICK_SQL
from fleetstats.plans.staging import session_folder
from fleetstats.plans.stand_ins import LOOPBACK, SAMPLES
from fleetstats.schemas import CONTAINERS, HISTORY, SNAPSHOT
from fleetstats.streaming.ingest import ingest, record_history, retained_history
from fleetstats.streaming.rates import stream_counter_rate
from fleetstats.streaming.sinks import FAILURES, read_table, start, table_sink, write_stream
from fleetstats.streaming.tables import LandedTable
from fleetstats.streaming.views import newest_updates, stream_latest, stream_sample, stream_sessions


def sample_stream(spark, folder):
    raw = table(spark, folder, "events")
    return samples_of(spark.readStream.schema(raw.schema).parquet(f"{folder}/events*.parquet"))


def samples_of(stream):
    return stream.select(
        F.col("user_id").alias("host"),
        F.col("event_type").alias("name"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def landed(stream, mode="append"):
    """Run a stream over what is there and give back the table it wrote."""
    spark = stream.sparkSession
    path = session_folder(spark, "stream")
    start(stream, table_sink(path), mode=mode, available_now=True).awaitTermination()
    rows = read_table(spark, path, stream.schema)
    return rows.withColumns(
        {
            f.name: F.col(f.name).cast("timestamp_ntz")
            for f in stream.schema.fields
            if f.dataType.simpleString() == "timestamp"
        }
    ).drop("batch_id")


@query("stream_counter_rate", COUNTER_RATE_SQL)
def stream_counter_rate_(spark, folder):
    counted = sample_stream(spark, folder).where(F.col("name") != LOOPBACK)
    return landed(stream_counter_rate(counted, ["k"], seq=["event_id"])).drop("late")


@query("stream_latest", LATEST_SQL)
def stream_latest_(spark, folder):
    updates = landed(stream_latest(sample_stream(spark, folder)), "update")
    return latest(updates, seq=["event_id"])


@query(
    "stream_tail",
    f"""SELECT host, ts, value AS cpu_avg, CAST(k AS DOUBLE) AS mem_percent FROM {SAMPLES}
    QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC) <= 20""",
)
def stream_tail(spark, folder):
    snapshots = sample_stream(spark, folder).select(
        "host",
        "ts",
        F.struct(F.col("value").alias("avgUsage")).alias("cpu"),
        F.struct(F.col("k").cast("double").alias("usedPercent")).alias("memory"),
    )
    path = session_folder(spark, "history")
    record_history(snapshots, path, available_now=True).awaitTermination()
    kind = "host bigint, ts timestamp, cpu_avg double, mem_percent double"
    return retained_history(spark, path, 20, kind).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# The watermark of the last batch: the newest event in whole milliseconds less the lateness bound.
_WATERMARK = """(SELECT make_timestamp(((epoch_us(max(ts)) // 1000) - 3600000) * 1000) FROM events)"""


@query(
    "stream_sessions",
    f"SELECT * FROM ({SESSIONS_SQL}) WHERE session_end <= {_WATERMARK}",
)
def stream_sessions_(spark, folder):
    """Closed sessions, as append mode emits them."""
    return landed(stream_sessions(sample_stream(spark, folder), late="1 hour"))


@query("stream_sessions_open", SESSIONS_SQL)
def stream_sessions_open(spark, folder):
    """All sessions, as complete mode shows them; each batch replaces the view."""
    stream = stream_sessions(sample_stream(spark, folder), late="1 hour")
    path = session_folder(spark, "sessions")

    def replace(batch, batch_id):
        batch.write.mode("overwrite").parquet(path)

    state = session_folder(spark, "sessions-state")
    start(stream, replace, checkpoint=state, mode="complete", available_now=True).awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(path)
    times = ("session_start", "last_message", "session_end")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


@query(
    "stream_sample",
    f"SELECT * FROM ({TICK_SQL}) WHERE tick + INTERVAL '1 hour' <= {_WATERMARK}",
)
def stream_sample_(spark, folder):
    """Closed ticks, as append mode emits them."""
    return landed(stream_sample(sample_stream(spark, folder), "1 hour", ["value", "k"], late="1 hour"))


@query("stream_sample_open", f"SELECT * FROM ({TICK_SQL})")
def stream_sample_open(spark, folder):
    """All ticks, open ones too, of what update mode landed in three batches."""
    files = session_folder(spark, "sample-input") + "/rows"
    rows = table(spark, folder, "events")
    for i in range(3):
        rows.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(files)
    stream = samples_of(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(files))
    ticks = stream_sample(stream, "1 hour", ["value", "k"], late="60 days")
    path = session_folder(spark, "sample-open")
    start(ticks, table_sink(path), mode="update", available_now=True).awaitTermination()
    return newest_updates(read_table(spark, path, ticks.schema)).withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query(
    "stream_ingest",
    f"""SELECT CASE {ROUTES} WHEN 'snapshot' THEN 'snapshots' WHEN 'docker' THEN 'containers'
        WHEN 'history' THEN 'history' ELSE 'rejected' END AS landed_in,
      CAST(host AS VARCHAR) AS host,
      CASE WHEN name IN ('click', 'view') THEN date_trunc('millisecond', ts)::TIMESTAMP
        WHEN name = 'purchase' THEN date_trunc('second', ts)::TIMESTAMP ELSE ts END AS ts,
      CASE WHEN name <> 'error' THEN value END AS reading,
      CASE WHEN name = 'signup' THEN date_trunc('second', ts)::TIMESTAMP END AS created,
      CASE WHEN name = 'error' THEN {ROUTES} END AS reason
    FROM {SAMPLES}""",
)
def stream_ingest(spark, folder):
    """Messages made of the events, decoded from a stream and landed, all tables together."""
    lines = session_folder(spark, "messages") + "/rows"
    sample_messages(spark, folder).write.parquet(lines)
    stream = spark.readStream.schema(spark.read.parquet(lines).schema).parquet(lines)
    tables = session_folder(spark, "ingested")
    ingest(stream, tables, available_now=True).awaitTermination()

    def rows(name, schema, reading, created="NULL", reason="NULL"):
        return read_table(spark, f"{tables}/{name}", schema).select(
            F.lit(name).alias("landed_in"),
            "host",
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            F.expr(f"CAST({reading} AS DOUBLE)").alias("reading"),
            F.expr(f"CAST({created} AS TIMESTAMP_NTZ)").alias("created"),
            F.expr(f"CAST({reason} AS STRING)").alias("reason"),
        )

    rejected = "host string, ts timestamp, value string, route string"
    return (
        rows("snapshots", SNAPSHOT, "cpu.avgUsage")
        .unionByName(rows("history", HISTORY, "cpu_avg"))
        .unionByName(rows("containers", CONTAINERS, "cpu_pct", "created"))
        .unionByName(rows("rejected", rejected, "NULL", reason="route"))
    )


@query(
    "stream_fan_out",
    f"""SELECT host, name, ts, event_id, value, k, 'first' AS target FROM {SAMPLES}
    UNION ALL SELECT host, name, ts, event_id, value, k, 'second' FROM {SAMPLES}
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 0, 'closed'""",
)
def stream_fan_out(spark, folder):
    """One stream written to two targets; an optional third fails, which is recorded and costs the others nothing.

    The failed target is a row with the batch that it missed as ``k``.
    """
    stream = sample_stream(spark, folder)
    first, second = session_folder(spark, "first"), session_folder(spark, "second")

    def closed(batch, batch_id):
        raise ConnectionError("the reader has gone")

    targets = {"first": first, "closed": closed, "second": second}
    failures = session_folder(spark, "failures")
    write_stream(stream, targets, failures, optional=["closed"], available_now=True).awaitTermination()
    missed = spark.read.schema(FAILURES).parquet(failures).select(F.col("batch_id").alias("k"), "target")
    one = read_table(spark, first, stream.schema).withColumn("target", F.lit("first"))
    two = read_table(spark, second, stream.schema).withColumn("target", F.lit("second"))
    both = one.unionByName(two).drop("batch_id").unionByName(missed, allowMissingColumns=True)
    return both.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "stream_delivery",
    f"""SELECT host, name, ts, event_id, value, k, 'steady' AS target FROM {SAMPLES}
    UNION ALL SELECT host, name, ts, event_id, value, k, 'shaky' FROM {SAMPLES}""",
)
def stream_delivery(spark, folder):
    """Six batches to two targets by an outbox; one fails three times in a row and still gets every row once."""
    source = sample_stream(spark, folder)
    rows = table(spark, folder, "events")
    files = f"{session_folder(spark, 'delivery-input')}/rows"
    for i in range(6):
        rows.where(F.col("event_id") % 6 == i).coalesce(1).write.mode("append").parquet(files)
    stream = samples_of(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(files))
    steady, shaky = session_folder(spark, "steady"), table_sink(session_folder(spark, "shaky"))
    failures = []

    def unreliable(batch, batch_id):
        if batch_id and len(failures) < 3:
            failures.append(batch_id)
            raise ConnectionError("the reader is away")
        shaky(batch, batch_id)

    outbox, state = session_folder(spark, "outbox"), session_folder(spark, "outbox-state")
    targets = {"steady": steady, "shaky": unreliable}
    write_stream(stream, targets, optional=["shaky"], outbox=outbox, checkpoint=state, available_now=True).awaitTermination()
    both = [read_table(spark, p, source.schema).withColumn("target", F.lit(t)) for t, p in (("steady", steady), ("shaky", shaky.path))]
    return both[0].unionByName(both[1]).drop("batch_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "history_landed",
    f"SELECT host, name, ts, event_id, value, k FROM {SAMPLES}",
)
def history_landed(spark, folder):
    """Samples written in a per-batch table and read back whole."""
    return landed(sample_stream(spark, folder))


@query(
    "history_compacted",
    f"""SELECT host, ts, value AS cpu_avg, CAST(k AS DOUBLE) AS mem_percent FROM {SAMPLES}
    QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC) <= 20""",
)
def history_compacted(spark, folder):
    """History landed in nine batches, which compaction joins by threes; its tail by the counts kept beside it."""
    snapshots = table(spark, folder, "events").select(
        F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("cpu_avg"),
        F.get_json_object("props", "$.k").cast("double").alias("mem_percent"), "event_id",
    )
    path = session_folder(spark, "history-compacted")
    landing = LandedTable(path, compact_every=3)
    for i in range(9):
        landing(snapshots.where(F.col("event_id") % 9 == i).drop("event_id"), i)
    kind = "host bigint, ts timestamp, cpu_avg double, mem_percent double"
    return retained_history(spark, path, 20, kind).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
