"""Joins, de-duplication, assembly, containers and process ranking over the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetstats.operators.assemble import assemble, disk_usage, process_table, with_addrs
from fleetstats.operators.containers import (
    container_cpu_pct,
    container_metrics,
    container_report,
    container_stats,
    containers,
)
from fleetstats.operators.flatten import (
    cpu_avg,
    cpu_core_report,
    cpu_cores,
    disk_report,
    disks,
    interface_report,
    interfaces,
    non_empty,
    process_report,
    processes,
    zero_fill,
)
from fleetstats.operators.topk import counts, process_counts, sort_view, top_processes
from fleetstats.plans.catalog import query, table
from fleetstats.plans.stand_ins import (
    COLORS,
    ORDER_TOTALS,
    PCT_CLASS,
    PROC_COLORS,
    SAMPLES,
    cents,
    order_totals,
    samples,
    sql_bytes,
    sql_class,
    sql_fixed,
    sql_rate,
)


@query(
    "iface_addrs",
    """SELECT o_custkey AS host, o_orderkey AS name, coalesce(string_agg(
        l_partkey || '.' || l_suppkey, ', ' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS addrs
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def iface_addrs(spark, folder):
    ifaces = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("host"), F.col("o_orderkey").alias("name")
    )
    addrs = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("name"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.concat_ws(".", "l_partkey", "l_suppkey").alias("addr"),
    )
    return with_addrs(ifaces, addrs, ["name"], seq=["l_linenumber", "l_partkey", "l_suppkey"]).select(
        "host", "name", "addrs"
    )


@query(
    "disk_first_usable",
    f"""WITH first AS (
      SELECT * FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1)
    SELECT o_custkey AS host, o_orderpriority AS device, o_orderkey AS mountpoint,
      CASE WHEN o_orderstatus = 'P' THEN 0 ELSE spent END AS total, quantity AS used
    FROM first JOIN {ORDER_TOTALS} ON id = o_orderkey WHERE o_orderstatus <> 'P' AND spent <> 0""",
)
def disk_first_usable(spark, folder):
    orders = table(spark, folder, "orders")
    partitions = orders.select(
        F.col("o_custkey").alias("host"),
        F.col("o_orderpriority").alias("device"),
        F.col("o_orderkey").alias("mountpoint"),
        F.col("o_orderkey").alias("seq"),
        "o_orderstatus",
    )
    size = F.when(F.col("o_orderstatus") == "P", F.lit(0).cast("bigint")).otherwise(F.col("spent"))
    usage = (
        order_totals(spark, folder)
        .withColumnRenamed("id", "mountpoint")
        .join(partitions, "mountpoint")
        .select("host", "mountpoint", size.alias("total"), F.col("quantity").alias("used"))
    )
    return disk_usage(partitions.drop("o_orderstatus"), usage, keys=["host"]).select(
        "host", "device", "mountpoint", "total", "used"
    )


@query(
    "container_metrics",
    f"""SELECT o_custkey AS host, o_orderkey AS id, o_orderstatus AS state,
      coalesce(quantity, 0) AS cpu_pct, coalesce(spent, 0) AS mem_usage, coalesce(lines, 0) AS mem_limit
    FROM orders LEFT JOIN {ORDER_TOTALS} ON id = o_orderkey AND o_orderstatus = 'F'""",
)
def container_metrics_(spark, folder):
    listed = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("host"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("state"),
    )
    stats = order_totals(spark, folder).withColumnsRenamed(
        {"quantity": "cpu_pct", "spent": "mem_usage", "lines": "mem_limit"}
    )
    return container_metrics(listed, stats, keys=["id"], running="F")


_STATE = "CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'exited' ELSE '' END"


def container_tables(spark, folder):
    """Container lists from orders and stats documents from their line item totals."""
    orders = table(spark, folder, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    host = F.col("o_custkey").cast("string").alias("host")
    listed = orders.select(
        host,
        "ts",
        F.col("o_orderkey").cast("string").alias("Id"),
        F.when(F.col("o_orderstatus") != "P", F.array(F.concat(F.lit("/c"), "o_orderkey"), F.lit("/other")))
        .otherwise(F.array().cast("array<string>"))
        .alias("Names"),
        F.col("o_orderpriority").alias("Image"),
        F.expr(_STATE).alias("State"),
        F.lit("").alias("Status"),
        F.unix_seconds("ts").alias("Created"),
    )

    def sample(cpu, system, *more):
        cpu_usage = F.struct(cpu.cast("decimal(20,0)").alias("total_usage")).alias("cpu_usage")
        return F.struct(cpu_usage, system.cast("decimal(20,0)").alias("system_cpu_usage"), *more)

    totals = order_totals(spark, folder).join(
        orders.select(F.col("o_orderkey").alias("id"), host, "ts"), "id"
    )
    memory = F.struct(
        F.col("spent").cast("decimal(20,0)").alias("usage"),
        (F.col("spent") * F.col("lines")).cast("decimal(20,0)").alias("limit"),
    )
    stats = totals.select(
        "host",
        "ts",
        F.col("id").cast("string").alias("id"),
        sample(
            F.col("quantity"), F.col("spent"), (F.col("lines") - 1).cast("int").alias("online_cpus")
        ).alias("cpu_stats"),
        sample(F.col("lines") * 10, F.col("lines")).alias("precpu_stats"),
        memory.alias("memory_stats"),
    )
    return listed, stats


CONTAINERS_SQL = f"""(
  SELECT CAST(o_custkey AS VARCHAR) AS host, o_orderdate AS ts, CAST(o_orderkey AS VARCHAR) AS id,
    CASE WHEN o_orderstatus <> 'P' THEN 'c' || o_orderkey ELSE '' END AS name,
    o_orderpriority AS image, {_STATE} AS state, '' AS status,
    CASE WHEN spent > lines AND lines > 1 AND quantity >= lines * 10
      THEN CAST(quantity - lines * 10 AS DOUBLE) / CAST(spent - lines AS DOUBLE)
        * CAST(lines - 1 AS DOUBLE) * 100 ELSE 0 END AS cpu_pct,
    coalesce(spent, 0) AS mem_usage, coalesce(spent * lines, 0) AS mem_limit
  FROM orders LEFT JOIN {ORDER_TOTALS} ON id = o_orderkey AND o_orderstatus = 'F')"""


@query("containers_table", f"SELECT *, ts AS created FROM {CONTAINERS_SQL}")
def containers_table(spark, folder):
    joined = containers(*container_tables(spark, folder))
    return joined.withColumns(
        {"ts": F.col("ts").cast("timestamp_ntz"), "created": F.col("created").cast("timestamp_ntz")}
    )


@query(
    "container_report",
    f"""SELECT host, ts, id, CASE WHEN name = '' THEN '-' ELSE name END AS name_text,
      image AS image_text, CASE WHEN state = '' THEN 'unknown' ELSE state END AS state_text,
      state AS badge, '-' AS status_text,
      CASE WHEN state = 'running' THEN {sql_fixed('cpu_pct', 1)} || '%' ELSE '-' END AS cpu_text,
      CASE WHEN state = 'running' AND mem_usage > 0
        THEN {sql_bytes('mem_usage')} || ' / ' || {sql_bytes('mem_limit')} ELSE '-' END AS mem_text,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_text
    FROM {CONTAINERS_SQL}""",
)
def container_report_(spark, folder):
    report = container_report(containers(*container_tables(spark, folder)))
    return report.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "container_cpu_pct",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
      CASE WHEN l_extendedprice > 0 AND l_linenumber > 1 AND l_quantity >= l_linenumber
        THEN (l_quantity - l_linenumber) / l_extendedprice * CAST(l_linenumber - 1 AS DOUBLE)
          * CAST(100 AS DOUBLE) ELSE 0 END AS cpu_pct
    FROM lineitem""",
)
def container_cpu_pct_(spark, folder):
    used = F.col("l_quantity") - F.col("l_linenumber")
    rows = container_cpu_pct(
        table(spark, folder, "lineitem"), used, "l_extendedprice", F.col("l_linenumber") - 1
    )
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cpu_pct")


@query(
    "container_cpu_poll",
    f"""WITH p AS (
      SELECT *, k - lag(k) OVER w AS used, event_id - lag(event_id) OVER w AS system FROM {SAMPLES}
      WINDOW w AS (PARTITION BY host, name ORDER BY ts))
    SELECT host, name AS id, ts, CASE WHEN system > 0 AND used >= 0
      THEN CAST(used AS DOUBLE) / CAST(system AS DOUBLE) * CAST(4 AS DOUBLE) * CAST(100 AS DOUBLE)
      ELSE 0 END AS cpu_pct, k AS mem_usage, event_id AS mem_limit FROM p""",
)
def container_cpu_poll(spark, folder):
    def sample(*more):
        cpu_usage = F.struct(F.col("k").cast("decimal(20,0)").alias("total_usage")).alias("cpu_usage")
        system = F.col("event_id").cast("decimal(20,0)").alias("system_cpu_usage")
        return F.struct(cpu_usage, system, *more)

    memory = F.struct(F.col("k").alias("usage"), F.col("event_id").alias("limit"))
    documents = samples(spark, folder).select(
        "host",
        F.col("name").alias("id"),
        "ts",
        sample(F.lit(4).alias("online_cpus")).alias("cpu_stats"),
        sample().alias("precpu_stats"),
        memory.alias("memory_stats"),
    )
    return container_stats(documents, baseline="poll")


@query(
    "container_counts",
    """SELECT o_custkey AS host, count(*) AS containers FROM orders GROUP BY o_custkey""",
)
def container_counts(spark, folder):
    rows = table(spark, folder, "orders").withColumnRenamed("o_custkey", "host")
    return counts(rows, ["host"], "containers")


@query(
    "container_sections",
    """SELECT vec_id AS host, label, len([x FOR x IN embedding IF x > 0.25]) AS shown FROM embeddings
    WHERE label <> 0 AND len([x FOR x IN embedding IF x > 0.25]) > 0""",
)
def container_sections(spark, folder):
    """High readings of each vector as its list; one labelled 0 has no list at all, not an empty one."""
    high = F.when(F.col("label") != 0, F.filter("embedding", lambda x: x > 0.25))
    listed = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("host"), "label", high.alias("containers")
    )
    shown = F.size("containers").cast("bigint").alias("shown")
    return non_empty(listed).select("host", "label", shown)


@query(
    "process_table",
    f"""SELECT host, event_id AS pid, CASE WHEN name <> 'signup' THEN name ELSE '' END AS name,
      CASE WHEN value < 300 THEN value ELSE 0 END AS cpu, CASE WHEN k >= 10 THEN k ELSE 0 END AS mem,
      name[1] AS status FROM {SAMPLES}""",
)
def process_table_(spark, folder):
    rows = samples(spark, folder).withColumnRenamed("event_id", "pid")
    attributes = {
        "name": rows.where("name <> 'signup'").select("pid", "name"),
        "cpu": rows.where("value < 300").select("pid", F.col("value").alias("cpu")),
        "mem": rows.where("k >= 10").select("pid", F.col("k").alias("mem")),
    }
    statuses = rows.select("pid", F.split("name", "").alias("statuses"))
    return process_table(
        rows.select("host", "pid"), attributes, statuses, ["pid"], {"mem": 0}
    )


def _processes(spark, folder):
    return samples(spark, folder).select(
        "host", F.col("event_id").alias("pid"), F.col("value").alias("cpu"), F.col("k").alias("mem")
    )


_PROCESSES = f"(SELECT host, event_id AS pid, value AS cpu, k AS mem FROM {SAMPLES})"
_TOP = f"(SELECT * FROM {_PROCESSES} ORDER BY cpu DESC, pid LIMIT 50)"


@query("top_processes", f"SELECT * FROM {_TOP}")
def top_processes_(spark, folder):
    return top_processes(_processes(spark, folder), keys=())


@query(
    "top_processes_per_host",
    f"""SELECT * FROM {_PROCESSES}
    QUALIFY row_number() OVER (PARTITION BY host ORDER BY cpu DESC, pid) <= 50""",
)
def top_processes_per_host(spark, folder):
    return top_processes(_processes(spark, folder), keys=["host"])


@query(
    "top_processes_by_mem",
    f"""SELECT * FROM {_PROCESSES}
    QUALIFY row_number() OVER (PARTITION BY host ORDER BY mem DESC, pid) <= 50""",
)
def top_processes_by_mem(spark, folder):
    return top_processes(_processes(spark, folder), keys=["host"], by="mem")


def _view_sql(order: str) -> str:
    return f"""SELECT *, CAST(row_number() OVER (PARTITION BY host ORDER BY {order}) AS INTEGER) AS rank FROM (
      SELECT * FROM {_PROCESSES}
      QUALIFY row_number() OVER (PARTITION BY host ORDER BY cpu DESC, pid) <= 20)"""


def _view(spark, folder, by):
    top = top_processes(_processes(spark, folder), 20, ["host"])
    return sort_view(top, by, ["host"])


@query("sort_view_cpu", _view_sql("cpu DESC, pid"))
def sort_view_cpu(spark, folder):
    return _view(spark, folder, "cpu")


@query("sort_view_mem", _view_sql("mem DESC, pid"))
def sort_view_mem(spark, folder):
    return _view(spark, folder, "mem")


@query("sort_view_pid", _view_sql("pid"))
def sort_view_pid(spark, folder):
    return _view(spark, folder, "pid")


@query(
    "process_counts",
    f"SELECT host, least(count(*), 50) AS shown FROM {_PROCESSES} GROUP BY host",
)
def process_counts_(spark, folder):
    return process_counts(_processes(spark, folder), keys=["host"])


@query(
    "zero_fill",
    f"""SELECT o_orderkey AS id, coalesce(spent, 0) AS spent, coalesce(lines, 0) AS lines,
      CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS status
    FROM orders LEFT JOIN {ORDER_TOTALS} ON id = o_orderkey""",
)
def zero_fill_(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.nullif("o_orderstatus", F.lit("P")).alias("status")
    )
    totals = order_totals(spark, folder).select("id", "spent", "lines")
    return zero_fill(orders.join(totals, "id", "left"))


@query(
    "cpu_cores",
    """SELECT vec_id AS host, CAST(i - 1 AS INTEGER) AS core, CAST(embedding[i] AS DOUBLE) AS percent
    FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)""",
)
def cpu_cores_(spark, folder):
    rows = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "host")
    return cpu_cores(rows, "embedding", ["host"])


@query(
    "cpu_core_report",
    f"""SELECT host, core, percent, {sql_fixed('percent', 0)} || '%' AS percent_text,
      {sql_class('percent', PCT_CLASS, 90, 70)} AS percent_class
    FROM (SELECT vec_id AS host, CAST(i - 1 AS INTEGER) AS core,
        abs(CAST(embedding[i] AS DOUBLE)) * 500 AS percent
      FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))""",
)
def cpu_core_report_(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("host"),
        F.transform("embedding", lambda x: F.abs(x.cast("double")) * 500).alias("usage"),
    )
    return cpu_core_report(cpu_cores(rows, "usage", ["host"]))


@query(
    "cpu_avg",
    """SELECT vec_id AS host, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding])
      / len(embedding), 9) AS cpu_avg FROM embeddings""",
)
def cpu_avg_(spark, folder):
    rows = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "host")
    return cpu_avg(rows, "embedding").select("host", F.round("cpu_avg", 9).alias("cpu_avg"))


def snapshot_parts(spark, folder):
    """Each order as a snapshot: its line items are disks, interfaces or processes by return flag.

    Orders of status P have no load, and some orders have no line items.
    """
    order = ("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, folder, "lineitem").withColumn("cents", cents("l_extendedprice"))

    def of(flag, **columns):
        fields = [F.expr(e).alias(n) for n, e in columns.items()]
        marks = [F.col(o).alias(f"_{o}") for o in order]
        rows = lines.where(F.col("l_returnflag") == flag)
        return rows.select(F.col("l_orderkey").alias("host"), *marks, *fields), [f"_{o}" for o in order]

    load = table(spark, folder, "orders").where("o_orderstatus <> 'P'").selectExpr(
        "o_orderkey AS host",
        "o_totalprice AS load1",
        "o_totalprice / 5 AS load5",
        "o_totalprice / 15 AS load15",
    )
    return {"load": load}, {
        "disks": of(
            "A",
            device="concat('sd', l_partkey)",
            mountpoint="concat('/', l_suppkey)",
            fstype="l_linestatus",
            total="cents * 4096",
            used="cents * 512",
            free="cents * 3584",
            usedPercent="l_quantity * 2",
        ),
        "network": of(
            "N",
            name="concat('eth', l_linenumber)",
            bytesSent="cents",
            bytesRecv="cents * 1024",
            addrs="CASE WHEN l_quantity < 25 THEN '' ELSE concat('10.0.0.', l_linenumber) END",
            sendRate="l_extendedprice",
            recvRate="l_extendedprice * 64",
        ),
        "processes": of(
            "R",
            pid="l_linenumber",
            name="concat('part', l_partkey)",
            cpu="l_quantity",
            mem="CAST(l_discount * 1000 AS FLOAT)",
            status="CASE l_linestatus WHEN 'F' THEN 'S' ELSE l_linestatus END",
        ),
    }


def snapshots(spark, folder):
    return assemble(*snapshot_parts(spark, folder), keys=["host"])


_LINES = """(SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)"""


def _sql_listed(text: str, flag: str) -> str:
    return f"""coalesce(string_agg({text}, ',' ORDER BY l_linenumber, l_partkey, l_suppkey)
        FILTER (WHERE l_returnflag = '{flag}'), '')"""


@query(
    "snapshot_assemble",
    f"""SELECT coalesce(l_orderkey, o_orderkey) AS host, any_value(o_totalprice) AS load1,
      any_value(o_totalprice) / 5 AS load5, any_value(o_totalprice) / 15 AS load15,
      {_sql_listed("'sd' || l_partkey", 'A')} AS disks,
      {_sql_listed("'eth' || l_linenumber", 'N')} AS network,
      {_sql_listed("'part' || l_partkey", 'R')} AS processes
    FROM lineitem FULL JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey
    GROUP BY coalesce(l_orderkey, o_orderkey)""",
)
def snapshot_assemble(spark, folder):
    def listed(array, field):
        return F.array_join(F.transform(array, lambda x: x[field]), ",").alias(array)

    return snapshots(spark, folder).select(
        "host", "load.*", listed("disks", "device"), listed("network", "name"), listed("processes", "name")
    )


@query(
    "snapshot_disks",
    f"""SELECT *, {sql_bytes('total')} AS total_text, {sql_bytes('used')} AS used_text,
      {sql_bytes('free')} AS free_text, {sql_fixed('used_percent', 1)} || '%' AS percent_text,
      {sql_class('used_percent', COLORS, 90, 70)} AS percent_color,
      {sql_class('used_percent', PCT_CLASS, 90, 70)} AS bar_class
    FROM (SELECT l_orderkey AS host, 'sd' || l_partkey AS device, '/' || l_suppkey AS mountpoint,
        l_linestatus AS fstype, cents * 4096 AS total, cents * 512 AS used, cents * 3584 AS free,
        l_quantity * 2 AS used_percent
      FROM {_LINES} WHERE l_returnflag = 'A')""",
)
def snapshot_disks(spark, folder):
    return disk_report(disks(snapshots(spark, folder), keys=["host"]))


@query(
    "snapshot_interfaces",
    f"""SELECT *, {sql_bytes('bytes_sent')} AS sent_text, {sql_bytes('bytes_recv')} AS recv_text,
      {sql_rate('send_rate')} AS send_rate_text, {sql_rate('recv_rate')} AS recv_rate_text
    FROM (SELECT l_orderkey AS host, 'eth' || l_linenumber AS name, cents AS bytes_sent,
        cents * 1024 AS bytes_recv,
        CASE WHEN l_quantity < 25 THEN '-' ELSE '10.0.0.' || l_linenumber END AS addrs,
        l_extendedprice AS send_rate, l_extendedprice * 64 AS recv_rate
      FROM {_LINES} WHERE l_returnflag = 'N')""",
)
def snapshot_interfaces(spark, folder):
    return interface_report(interfaces(snapshots(spark, folder), keys=["host"]))


@query(
    "snapshot_processes",
    f"""SELECT *, {sql_fixed('cpu', 1)} AS cpu_text, {sql_class('cpu', PROC_COLORS, 50, 20, '>')} AS cpu_color,
      {sql_fixed('CAST(mem AS DOUBLE)', 1)} AS mem_text,
      {sql_class('mem', PROC_COLORS, 50, 20, '>')} AS mem_color,
      CASE status WHEN 'S' THEN 'SLP' ELSE status END AS status_text
    FROM (SELECT l_orderkey AS host, l_linenumber AS pid, 'part' || l_partkey AS name,
        l_quantity AS cpu, CAST(l_discount * 1000 AS FLOAT) AS mem,
        CASE l_linestatus WHEN 'F' THEN 'S' ELSE l_linestatus END AS status
      FROM lineitem WHERE l_returnflag = 'R')""",
)
def snapshot_processes(spark, folder):
    return process_report(processes(snapshots(spark, folder), keys=["host"]))
