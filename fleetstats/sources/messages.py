"""The tagged JSON message: ``{"type": ..., "payload": ...}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstats.functions.times import rfc3339, s_to_ts, ts_to_ms, ts_to_s
from fleetstats.schemas import CONTAINER_WIRE, DOCUMENTS, HISTORY_WIRE, SNAPSHOT_DOCUMENT
from fleetstats.sources.snapshots import narrow

# Message types.
SNAPSHOT_TYPE = "snapshot"
HISTORY_TYPE = "history"
CONTAINERS_TYPE = "docker"
TYPES = (SNAPSHOT_TYPE, HISTORY_TYPE, CONTAINERS_TYPE)

# The column with a message's parsed payload.
BODY = "body"

# What becomes of a message: one of the types, or one of these.
UNKNOWN = "unknown"
CORRUPT = "corrupt"


def message(kind: str, payload: Column) -> Column:
    return F.to_json(
        F.struct(F.lit(kind).alias("type"), payload.alias("payload")), {"ignoreNullFields": "false"}
    )


def encode(df: DataFrame, kind: str, payload: str | Column, name: str = "value") -> DataFrame:
    """Add the message text of a payload column."""
    column = F.col(payload) if isinstance(payload, str) else payload
    return df.withColumn(name, message(kind, column))


def decode(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``route``, ``payload`` (JSON text) and ``body`` (the same, parsed) to message texts.

    A text is parsed once, into a variant, and every table is cut from that; ``payload`` costs nothing unless it is read.

    A message without a type, or with an empty one, is a bare snapshot: the whole text is the
    payload.  Unknown types and unparsable texts are marked, so the caller decides what becomes of
    them, and none stops the job; so are objects that have a key twice.  A payload that is missing or does not parse is as corrupt as a
    message: so is a snapshot without host or time, a history with a point without time, and a list with a container without id.
    """
    parsed = df.withColumn("_message", F.try_parse_json(value))
    kind = F.nullif(F.try_variant_get("_message", "$.type", "string"), F.lit(""))
    whole = F.col("_message")
    body = F.when(kind.isNull(), whole).otherwise(F.try_variant_get("_message", "$.payload", "variant"))
    text = F.when(kind.isNull(), F.col(value)).otherwise(F.get_json_object(value, "$.payload"))
    routed = parsed.withColumns({"_kind": F.coalesce(kind, F.lit(SNAPSHOT_TYPE)), BODY: body})
    host, at = F.try_variant_get(BODY, "$.system.hostname", "string"), F.try_variant_get(BODY, "$.timestamp", "bigint")
    sound = (
        F.when(F.col("_kind") == SNAPSHOT_TYPE, host.isNotNull() & at.isNotNull())
        .when(F.col("_kind") == HISTORY_TYPE, F.forall(_points(), lambda p: p.t.isNotNull()))
        .when(F.col("_kind") == CONTAINERS_TYPE, F.forall(_listed(), lambda c: c.id.isNotNull()))
    )
    route = (
        F.when(F.col("_message").isNull(), CORRUPT)
        .when(~F.col("_kind").isin(*TYPES), UNKNOWN)
        .when(F.coalesce(sound, F.lit(False)), F.col("_kind"))
        .otherwise(CORRUPT)
    )
    told = routed.withColumn("route", route)
    known = F.col("route").isin(*TYPES)
    return told.withColumns({"payload": F.when(known, text), BODY: F.when(known, F.col(BODY))}).drop("_message", "_kind")


def _points(body: str = BODY) -> Column:
    return F.try_variant_get(body, "$", HISTORY_WIRE)


def _listed(body: str = BODY) -> Column:
    return F.try_variant_get(body, "$", CONTAINER_WIRE)


def snapshot_payload() -> Column:
    """Wire document of a landed snapshot."""
    return F.struct(ts_to_ms("ts").alias("timestamp"), *DOCUMENTS)


def history_point() -> Column:
    return F.struct(
        ts_to_s("ts").alias("t"), F.col("cpu_avg").alias("c"), F.col("mem_percent").alias("m")
    )


def containers_payload(landed: DataFrame, keys: tuple[str, ...] = ("host", "ts")) -> DataFrame:
    """Wire documents of landed containers: per host and tick one ``payload``, the list of its containers by id."""
    wire = F.struct(
        "id", "name", "image", "state", "status",
        F.col("cpu_pct").alias("cpuPct"), F.col("mem_usage").alias("memUsage"), F.col("mem_limit").alias("memLimit"),
        rfc3339(ts_to_s("created")).alias("created"),
    )
    return landed.groupBy(*keys).agg(F.sort_array(F.collect_list(wire)).alias("payload"))


def snapshots(decoded: DataFrame, body: str = BODY) -> DataFrame:
    """Landed snapshots of the decoded messages."""
    document = F.try_variant_get(body, "$", SNAPSHOT_DOCUMENT).alias("_document")
    return narrow(
        decoded.where(F.col("route") == SNAPSHOT_TYPE).select(document).select("_document.*")
    )


def history(decoded: DataFrame, body: str = BODY, host: str = "host") -> DataFrame:
    """History points of the decoded messages; the host is known to the transport, not the payload."""
    return (
        decoded.where(F.col("route") == HISTORY_TYPE)
        .select(host, F.inline(_points(body)))
        .select(
            host, s_to_ts("t").alias("ts"), F.col("c").alias("cpu_avg"), F.col("m").alias("mem_percent")
        )
    )


def containers(
    decoded: DataFrame, body: str = BODY, host: str = "host", ts: str = "ts"
) -> DataFrame:
    """Containers of the decoded messages, stamped with host and arrival time by the transport."""
    return (
        decoded.where(F.col("route") == CONTAINERS_TYPE)
        .select(host, ts, F.inline(_listed(body)))
        .select(
            host,
            ts,
            "id",
            "name",
            "image",
            "state",
            "status",
            F.col("cpuPct").alias("cpu_pct"),
            F.expr("try_cast(memUsage AS bigint)").alias("mem_usage"),
            F.expr("try_cast(memLimit AS bigint)").alias("mem_limit"),
            F.try_to_timestamp("created").alias("created"),
        )
    )
