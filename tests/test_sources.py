import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetstats.operators.containers import (
    container_metrics,
    container_report,
    container_stats,
    containers,
    cpu_pct,
)
from fleetstats.schemas import CONTAINER_LIST, CONTAINER_STATS, HISTORY, SNAPSHOT
from fleetstats.session import shared_folder
from fleetstats.sources import messages
from fleetstats.sources.replay import replay
from fleetstats.sources.snapshots import read_containers, read_snapshots

T = datetime(2024, 1, 1)
NET = {"name": "eth0", "bytesSent": 2**64 - 1, "bytesRecv": 7, "addrs": "", "sendRate": 0.5, "recvRate": 0}
WIRE = {
    "timestamp": 1704067200123,
    "system": {"hostname": "h", "uptime": 5},
    "cpu": {"cores": 2, "threads": 4, "usage": [1.5, 2.5], "avgUsage": 2.0},
    "memory": {"total": 10, "usedPercent": 50.0},
    "disks": None,
    "network": [NET],
    "processes": [],
}


def write(path, *lines):
    path.mkdir()
    (path / "part.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(path)


def test_json_snapshots(spark, tmp_path):
    row = read_snapshots(spark, write(tmp_path / "s", WIRE), "json").first()
    assert (row.host, row.ts) == ("h", datetime(2024, 1, 1, 0, 0, 0, 123000))
    assert row.network[0].bytesSent is None and row.network[0].bytesRecv == 7
    assert row.disks is None and row.processes == [] and row.load is None
    assert row.cpu.usage == [1.5, 2.5] and row.system.uptime == 5


def test_snapshots_land_and_stream(spark, tmp_path):
    landed = str(tmp_path / "landed")
    snaps = read_snapshots(spark, write(tmp_path / "s", WIRE), "json")
    snaps.write.parquet(landed)
    assert read_snapshots(spark, landed).schema == snaps.schema
    assert read_snapshots(spark, landed).first() == snaps.first()
    assert read_snapshots(spark, landed, streaming=True).isStreaming
    assert read_snapshots(spark, str(tmp_path / "s"), "json", streaming=True).isStreaming


def listed(name, state, names=("/web",)):
    return {"host": "h", "ts": "2024-01-01T00:00:00Z", "Id": name, "Names": list(names), "Image": "i", "State": state, "Created": 60}


def stats(name, cpu, system, online, before=(0, 0), usage=2048):
    return {
        "host": "h",
        "ts": "2024-01-01T00:00:00Z",
        "id": name,
        "cpu_stats": {"cpu_usage": {"total_usage": cpu}, "system_cpu_usage": system, "online_cpus": online},
        "precpu_stats": {"cpu_usage": {"total_usage": before[0]}, "system_cpu_usage": before[1]},
        "memory_stats": {"usage": usage, "limit": 4096},
    }


def test_containers_from_lists_and_stats(spark, tmp_path):
    lists = write(
        tmp_path / "l",
        listed("a", "running"),
        listed("b", "exited"),
        listed("c", "running", []),
        listed("d", "running"),
        listed("e", "running"),
    )
    documents = write(
        tmp_path / "d",
        stats("a", 30, 200, 4, (10, 100)),
        stats("b", 30, 200, 4),
        '{"host": "h", "id": broken',
        stats("d", 5, 200, 4, (10, 100)),
        stats("e", 30, 100, 4, (10, 100), usage=0),
    )
    table = containers(*read_containers(spark, lists, documents))
    got = {r.id: (r.name, r.cpu_pct, r.mem_usage, r.mem_limit) for r in table.collect()}
    assert got == {
        "a": ("web", 80.0, 2048, 4096),
        "b": ("web", 0.0, 0, 0),
        "c": ("", 0.0, 0, 0),
        "d": ("web", 0.0, 2048, 4096),
        "e": ("web", 0.0, 0, 4096),
    }
    report = {r.id: r for r in container_report(table).collect()}
    assert (report["a"].cpu_text, report["a"].mem_text) == ("80.0%", "2.0 KB / 4.0 KB")
    assert (report["b"].cpu_text, report["b"].mem_text, report["b"].badge) == ("-", "-", "exited")
    assert (report["c"].name_text, report["c"].cpu_text, report["c"].mem_text) == ("-", "0.0%", "-")
    assert report["e"].mem_text == "-"
    assert report["a"].created_text == "1970-01-01 00:01:00"


def test_cpu_percent_guards(values):
    rows = [(10, 100, 2), (10, 0, 2), (10, 100, 0), (-1, 100, 2), (None, 100, 2)]
    got = values(cpu_pct("c", "s", "n"), rows, "c bigint, s bigint, n int")
    assert got == [20.0, 0.0, 0.0, 0.0, 0.0]


def test_percent_between_polls(spark, tmp_path):
    first, second = stats("a", 10, 100, 2), stats("a", 30, 200, 2)
    second["ts"] = "2024-01-01T00:00:05Z"
    documents = spark.read.schema(CONTAINER_STATS).json(write(tmp_path / "d", first, second))
    got = container_stats(documents, baseline="poll").orderBy("ts").collect()
    assert [r.cpu_pct for r in got] == [0.0, 40.0]
    embedded = container_stats(documents).orderBy("ts").collect()
    assert [r.cpu_pct for r in embedded] == [20.0, 30.0]
    with pytest.raises(ValueError):
        container_stats(documents, baseline="none")


def test_metrics_only_for_running(spark):
    c = spark.createDataFrame([("h", T, "a", "running"), ("h", T, "b", "paused")], "host string, ts timestamp, id string, state string")
    s = spark.createDataFrame([("h", T, "a", 1.0), ("h", T, "b", 2.0)], "host string, ts timestamp, id string, cpu_pct double")
    got = container_metrics(c, s, ["cpu_pct"]).collect()
    assert sorted((r.id, r.cpu_pct) for r in got) == [("a", 1.0), ("b", 0.0)]


def test_decode_routes_every_message(spark):
    texts = {
        '{"type":"snapshot","payload":{"timestamp":5,"system":{"hostname":"h"},"a":1}}': (
            "snapshot", '{"timestamp":5,"system":{"hostname":"h"},"a":1}'
        ),
        '{"type":"snapshot","payload":{"a":1}}': ("corrupt", None),
        '{"type":"history","payload":[{"t":1}]}': ("history", '[{"t":1}]'),
        '{"type":"docker","payload":[]}': ("docker", "[]"),
        '{"type":"docker","payload":null}': ("corrupt", None),
        '{"timestamp":5,"system":{"hostname":"h"}}': ("snapshot", '{"timestamp":5,"system":{"hostname":"h"}}'),
        '{"type":"","timestamp":5,"system":{"hostname":"h"}}': ("snapshot", '{"type":"","timestamp":5,"system":{"hostname":"h"}}'),
        '{"timestamp":5}': ("corrupt", None),
        '{"type":"weather","payload":{}}': ("unknown", None),
        '{"type":"snapshot","payload":{': ("corrupt", None),
        "not json": ("corrupt", None),
        "": ("corrupt", None),
    }
    got = messages.decode(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert {r.value: (r.route, r.payload) for r in got} == texts


def test_encode_decode_round_trip(spark, tmp_path):
    snaps = read_snapshots(spark, write(tmp_path / "s", WIRE), "json")
    sent = messages.encode(snaps, "snapshot", messages.snapshot_payload())
    text = json.loads(sent.first().value)
    assert text["type"] == "snapshot" and text["payload"]["timestamp"] == 1704067200123
    back = messages.snapshots(messages.decode(sent.select("value")))
    assert back.first() == snaps.first()


def test_containers_message(spark):
    payload = [{"id": "a", "state": "running", "cpuPct": 1.5, "memUsage": 2**64 - 1, "memLimit": 5, "created": "2024-01-01T00:00:00Z"}]
    text = json.dumps({"type": "docker", "payload": payload})
    df = spark.createDataFrame([("h", T, text)], "host string, ts timestamp, value string")
    row = messages.containers(messages.decode(df)).first()
    assert (row.id, row.cpu_pct, row.mem_usage, row.mem_limit, row.created) == ("a", 1.5, None, 5, T)


def test_replay_sends_snapshot_then_history(spark, tmp_path):
    snaps = read_snapshots(spark, write(tmp_path / "s", WIRE, {**WIRE, "timestamp": 1704067300000}), "json")
    lone = snaps.withColumn("host", F.lit("lone"))
    history = spark.createDataFrame([("h", datetime(2024, 1, 1, 0, 0, i), float(i), 1.0) for i in range(5)], HISTORY)
    sent = replay(snaps.unionByName(lone), history, n=3).orderBy("host", "place").collect()
    assert [(r.host, r.place) for r in sent] == [("h", 0), ("h", 1), ("lone", 0)]
    assert json.loads(sent[0].value)["payload"]["timestamp"] == 1704067300000
    points = json.loads(sent[1].value)["payload"]
    assert [p["c"] for p in points] == [2.0, 3.0, 4.0] and points[0]["t"] == 1704067202
    assert replay(snaps, history, host="other").count() == 0


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_schemas_match_their_lists(spark):
    assert spark.createDataFrame([], CONTAINER_LIST).columns[:2] == ["host", "ts"]
    assert spark.createDataFrame([], SNAPSHOT).columns[:2] == ["host", "ts"]
