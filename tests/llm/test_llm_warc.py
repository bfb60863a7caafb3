import base64
import hashlib
import os

import pytest

from fleetstats.llm import warc as A
from fleetstats.llm.catalog import load

FOLDER = "/root/testdata/sf0.001"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows, least=0):
    payloads = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, p in payloads:
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in payloads:
        refers = first.get(p) if first.get(p) != i else None
        out.append((i, len(p), digest(p), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


ROWS = [
    (5, "http://a/ b\n", "<p>one</p>"), (3, None, "<p>one</p>"), (9, "http://c/é", "<p>two</p>"), (1, "u", None), (2, "u", ""),
    (7, "u", "x" * 300000), (8, "u", "x" * 300000), (5, "http://a/ b\n", "<p>one</p>"), (3, None, "<p>one</p>"), (None, "n", "<p>one</p>"),
    (None, "n", "lone"), (-4, "u", "h\r\n\r\nWARC/1.1\r\n"), (2**62, "far", "far"),
] + [(100 + i, f"u{i}", f"page {i % 60} " * 40) for i in range(200)]


def answers(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 20_000, "roll_bytes": 2_000}, {"least_bytes": 11}])
def test_round_trip_equals_brute_force(spark, tmp_path, options):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").selectExpr("*", "1 as digest", "2 as shard")
    listed = A.write_warc(pages, str(tmp_path / "a"), **options)
    back = A.read_warc(spark, str(tmp_path / "a"))
    assert answers(back) == brute([(i, h) for i, _, h in ROWS], options.get("least_bytes", 0))
    payloads = {(r.page_id, bytes(r.payload)) for r in back.where("record_type = 'response'").collect()}
    assert payloads <= {(i, (h or "").encode()) for i, _, h in ROWS}
    names = {r.name for r in listed.collect()}
    assert names == {f for f in os.listdir(tmp_path / "a") if f.endswith(".gz")}
    assert not os.path.exists(tmp_path / "a" / "temporary")
    if options.get("roll_bytes"):
        assert len(names) > 5 and max(r.seq for r in listed.collect()) > 0
        by_file = {}
        for r in back.where("page_id is not null").collect():
            by_file.setdefault(r.file.rsplit("-", 1)[0], []).append(r.page_id)
        bounds = sorted((min(v), max(v)) for v in by_file.values())
        assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))


def test_files_depend_on_the_rows_alone(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    kinds = {"shard_bytes": 20_000, "roll_bytes": 2_000}
    one = A.write_warc(pages, str(tmp_path / "a"), **kinds).select("name", "bytes", "sha256")
    two = A.write_warc(pages.repartition(7).orderBy(A.F.rand(3)), str(tmp_path / "b"), **kinds).select("name", "bytes", "sha256")
    assert sorted(one.collect()) == sorted(two.collect())


def test_damage_is_noticed(spark, tmp_path):
    A.write_warc(spark.createDataFrame(ROWS, "page_id bigint, url string, html string"), str(tmp_path / "a"))
    name = next(f for f in os.listdir(tmp_path / "a") if f.endswith(".gz"))
    data = (tmp_path / "a" / name).read_bytes()
    members = list(A.members(__import__("io").BytesIO(data)))
    with pytest.raises(ValueError):
        A.parse(members[2].replace(b"<p>", b"<q>").replace(b"page", b"pagf").replace(b"far", b"fur").replace(b"h\r", b"g\r").replace(b"u", b"v"), name)
    with pytest.raises((ValueError, Exception)):
        list(A.members(__import__("io").BytesIO(data[:-20])))


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert A.write_warc(pages, str(tmp_path / "a")).count() == 0
    assert A.read_warc(spark, str(tmp_path / "a")).count() == 0


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html").collect()]
    assert answers(load()[0]["op3_warc"](spark, FOLDER)) == brute(rows)
