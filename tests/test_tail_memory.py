"""What tails leave out of the work, and how they deal it."""

from pyspark.sql import functions as F
from test_plans import final_plan

from fleetstats.operators import series
from fleetstats.operators.series import tail


def points(spark, hosts, each, step):
    """``each`` rows a host, ``step`` seconds apart; the last host has no name, and its first row a clock far off."""
    rows = spark.range(hosts * each).withColumn("i", F.col("id") % each)
    host = F.when(F.col("id") < (hosts - 1) * each, F.floor(F.col("id") / each))
    first = F.col("host").isNull() & (F.col("i") == 0)
    at = F.timestamp_seconds(F.when(first, 0).otherwise(1_700_000_000 + step * F.col("i")))
    return rows.withColumn("host", host).select("host", at.alias("ts"), "id")


def wanted(df, n):
    place = "row_number() OVER (PARTITION BY host ORDER BY ts DESC)"
    return sorted(r.id for r in df.selectExpr("id", f"{place} AS place").where(F.col("place") <= n).collect())


def test_hosts_with_no_more_rows_than_the_tail_are_not_sorted(spark):
    df = points(spark, 40, 30, 700)
    plan = final_plan(tail(df, 30))
    assert "Window" not in plan and "Exchange" not in plan
    for n in (29, 30):
        assert sorted(r.id for r in tail(df, n).collect()) == wanted(df, n)


def test_sparse_rows_have_far_fewer_slices_than_rows(spark, monkeypatch):
    df, staged = points(spark, 40, 300, 700), {}
    grouped, found = series.slice_start, series._sparse_width
    monkeypatch.setattr(series, "slice_start", lambda ts, width: staged.setdefault(width, grouped(ts, width)))
    monkeypatch.setattr(series, "_sparse_width", lambda *args: staged.setdefault("width", found(*args)))
    got = sorted(r.id for r in tail(df, 20).collect())
    assert got == wanted(df, 20)
    assert df.select("host", staged[staged["width"]]).distinct().count() <= df.count() / 12
    # Rows that lie dense keep their slices.
    assert found(points(spark, 4, 4000, 2), 20, ["host"], "ts", "10 minutes") == "600000000 microseconds"


def test_rows_that_stay_are_dealt_by_their_number(spark, monkeypatch):
    df = points(spark, 40, 300, 700)
    monkeypatch.setattr(series, "TASK_ROWS", 700)
    kept = tail(df, 200)
    assert "REPARTITION_BY_NUM" in final_plan(kept)
    assert sorted(r.id for r in kept.collect()) == wanted(df, 200)
