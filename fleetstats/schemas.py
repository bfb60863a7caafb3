"""Schemas of the landed telemetry.

Field names inside structs are the wire names of the JSON documents; flat tables use snake_case.
Byte counters are unsigned 64 bit on the wire.  JSON is therefore read with ``decimal(20,0)`` and
narrowed to ``bigint`` by ``fleetstats.sources.snapshots.narrow``; a value beyond ``bigint`` becomes
NULL instead of failing the job.  Schemas are DDL texts, which every reader takes.
"""

from __future__ import annotations

WIRE_COUNTER = "decimal(20,0)"
STORED_COUNTER = "bigint"


def _documents(counter: str) -> dict[str, str]:
    return {
        "system": (
            "struct<hostname:string,os:string,platform:string,kernel:string,arch:string,"
            f"uptime:{counter},goVersion:string>"
        ),
        "cpu": "struct<model:string,cores:int,threads:int,usage:array<double>,avgUsage:double>",
        "memory": (
            f"struct<total:{counter},used:{counter},available:{counter},usedPercent:double,"
            f"swapTotal:{counter},swapUsed:{counter},swapPercent:double>"
        ),
        "disks": (
            "array<struct<device:string,mountpoint:string,fstype:string,"
            f"total:{counter},used:{counter},free:{counter},usedPercent:double>>"
        ),
        "network": (
            f"array<struct<name:string,bytesSent:{counter},bytesRecv:{counter},addrs:string,"
            "sendRate:double,recvRate:double>>"
        ),
        "load": "struct<load1:double,load5:double,load15:double>",
        "processes": "array<struct<pid:int,name:string,cpu:double,mem:float,status:string>>",
    }


def _ddl(fields: dict[str, str], **leading: str) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in {**leading, **fields}.items())


# The documents of a landed snapshot and their types.
DOCUMENTS = _documents(STORED_COUNTER)

# One JSON document per tick, as it arrives: ``timestamp`` is epoch milliseconds.
SNAPSHOT_WIRE = _ddl(_documents(WIRE_COUNTER), timestamp="bigint")
# The same as one type.
SNAPSHOT_DOCUMENT = f"struct<{SNAPSHOT_WIRE}>"
# The landed table: keyed by host and event time.
SNAPSHOT = _ddl(DOCUMENTS, host="string", ts="timestamp")

HISTORY = "host string, ts timestamp, cpu_avg double, mem_percent double"
# History on the wire: ``t`` is epoch seconds.
HISTORY_WIRE = "array<struct<t:bigint,c:double,m:double>>"

CONTAINERS = (
    "host string, ts timestamp, id string, name string, image string, state string, status string, "
    "cpu_pct double, mem_usage bigint, mem_limit bigint, created timestamp"
)
CONTAINER_WIRE = (
    "array<struct<id:string,name:string,image:string,state:string,status:string,cpuPct:double,"
    f"memUsage:{WIRE_COUNTER},memLimit:{WIRE_COUNTER},created:string>>"
)

CONTAINER_LIST = (
    "host string, ts timestamp, Id string, Names array<string>, Image string, State string, "
    "Status string, Created bigint"
)
_CPU_SAMPLE = f"cpu_usage:struct<total_usage:{WIRE_COUNTER}>,system_cpu_usage:{WIRE_COUNTER}"
CONTAINER_STATS = (
    "host string, ts timestamp, id string, "
    f"cpu_stats struct<{_CPU_SAMPLE},online_cpus:int>, precpu_stats struct<{_CPU_SAMPLE}>, "
    f"memory_stats struct<usage:{WIRE_COUNTER},limit:{WIRE_COUNTER}>"
)
