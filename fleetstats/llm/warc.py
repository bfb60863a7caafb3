"""WARC archives written in deterministic shards, and read back.

Pages are sorted by id into ranges whose bounds follow from the data alone; a task writes a range's files and
begins a new one when the compressed size says so.  Headers and digests are made anew.  Tasks
write under temporary names of their own, and what they return is a manifest: only files of attempts
that Spark commits are in it, only they get their final names, and only they are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.llm.catalog import query, table
from fleetstats.plans.staging import session_folder, stage

SHARD_BYTES = 64 * 2**20  # of payload per task, more if that made over MOST_SHARDS tasks
MOST_SHARDS = 20_000
SAMPLE = 20_000  # pages, taken by hash, whose ids bound the ranges
ROLL_BYTES = 16 * 2**20  # compressed size from which a file is ended
LEVEL = 6
DATE = "2020-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URL = "urn:x-no-url"
BATCH_BYTES = 8 * 2**20  # payload in a batch of records read

MANIFEST = "name string, temporary string, shard int, seq int, records bigint, bytes bigint, sha256 string"
RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, payload binary, file string"
)


def files_of(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there; any that both Spark and Arrow know."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return pafs.FileSystem.from_uri(folder)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{digest}')}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member without a time, so equal records are equal bytes."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """The record of a page: a revisit of page ``first`` if that is given, else a response."""
    digest = sha1_base32(payload)
    safe = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or NO_URL)
    headers = [
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", safe),
        ("WARC-Payload-Digest", "sha1:" + digest),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first is None:
        return record("response", headers, http + payload)
    headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page-Id", str(first))]
    return record("revisit", headers, http)


class ShardWriter:
    """The files of one task, each under a temporary name of this attempt."""

    def __init__(self, folder: str, roll: int) -> None:
        self.fs, self.path = files_of(folder)
        self.roll, self.attempt = roll, uuid.uuid4().hex
        self.shard, self.seq, self.out, self.rows = -1, 0, None, []

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.seq = shard, 0
        elif self.out is not None and self.bytes + len(data) > self.roll:
            self.close()
            self.seq += 1
        if self.out is None:
            self._open()
        self._put(data)
        self.records += 1

    def _open(self) -> None:
        self.name = f"shard-{self.shard:06d}-{self.seq:04d}.warc.gz"
        self.temporary = f"temporary/{self.attempt}-{self.name}"
        self.fs.create_dir(f"{self.path}/temporary", recursive=True)
        self.out = self.fs.open_output_stream(f"{self.path}/{self.temporary}", compression=None)
        self.bytes, self.records, self.sha = 0, 0, hashlib.sha256()
        info = f"software: fleetstats\r\nformat: WARC File Format 1.1\r\n".encode()
        headers = [("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        self._put(record("warcinfo", headers, info))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)
        self.sha.update(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.name, self.temporary, self.shard, self.seq, self.records, self.bytes, self.sha.hexdigest()))
            self.out = None


def _to_batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_MANIFEST = pa.schema(
    [("name", pa.string()), ("temporary", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
)
_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string())]
)


def _place(cuts: list[tuple[int, int]]):
    """A function from (order, tie) arrays to the range they fall in."""
    first = np.array([c[0] for c in cuts], np.int64)
    second = np.array([c[1] for c in cuts], np.int64)

    def place(order: np.ndarray, tie: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(first, order, "left"), np.searchsorted(first, order, "right")
        for i in np.flatnonzero(high > low):
            low[i] += np.searchsorted(second[low[i] : high[i]], tie[i], "right")
        return low

    return place


def range_cuts(keys: DataFrame, shards: int) -> list[tuple[int, int]]:
    """Bounds that cut the rows of ``keys`` (order, tie) into ``shards`` even ranges.

    They come from the rows with the smallest hashes, so the same rows always give the same bounds, and an outlying
    id does not stretch a range.
    """
    if shards < 2:
        return []
    mark = F.xxhash64("order", "tie")
    sample = keys.select("order", "tie").orderBy(mark, "order", "tie").limit(SAMPLE).collect()
    rows = sorted((r.order, r.tie) for r in sample)
    return sorted({rows[len(rows) * i // shards] for i in range(1, shards)}) if rows else []


def write_warc(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write a record per row of ``pages`` under ``folder`` and return the manifest, which is also kept there.

    A null html is an empty payload.  Of equal payloads of ``least_bytes`` and more the row with the smallest page_id
    is the response and the others revisit it; rows that repeat it, id and all, are responses as well.  A row without
    page_id comes after all others and is a response if no row of its payload has an id.  A null url is recorded as
    NO_URL; white space and unprintable characters in one are percent-encoded.  Other columns are not
    read.  An empty table gives an empty manifest.  A folder that has a manifest is refused.

    Payloads are shuffled once, to their range.  What decides between response and revisit moves as ids and digests.
    """
    spark = pages.sparkSession
    plain = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    )
    keys = plain.select(
        "page_id", F.octet_length("payload").alias("size"), F.sha2("payload", 256).alias("digest")
    ).withColumns({"order": F.coalesce("page_id", F.lit(2**63 - 1)), "tie": F.xxhash64("digest")})
    keys = stage(keys, "warc-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    shards = max(1, min(MOST_SHARDS, -(-total // shard_bytes)))
    cuts = range_cuts(keys, shards)
    place = _place(cuts)

    @F.arrow_udf("int")
    def shard(order: pa.Array, tie: pa.Array) -> pa.Array:
        return pa.array(place(order.to_numpy(zero_copy_only=False), tie.to_numpy(zero_copy_only=False)), pa.int32())

    groups = keys.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    groups = stage(groups.where("rows > 1 and first is not null").select("digest", "first"), "warc-groups")
    revisits = (
        keys.join(groups, "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("first")))
        .select("page_id", "digest", "order", "tie", "first")
        .distinct()
    )
    moved = plain.withColumn("digest", F.sha2("payload", 256)).withColumns(
        {"order": F.coalesce("page_id", F.lit(2**63 - 1)), "tie": F.xxhash64("digest")}
    )
    # A decision sorts before the pages that it is for.
    rows = moved.withColumns({"first": F.lit(None).cast("bigint"), "page": F.lit(True)}).unionByName(
        revisits.withColumn("page", F.lit(False)), allowMissingColumns=True
    )
    rows = rows.withColumn("shard", shard("order", "tie"))
    sorted_rows = rows.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "order", "digest", "page", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, decided = ShardWriter(folder, roll_bytes), None
        for batch in batches:
            for page_id, url, payload, digest, first, page, shard in zip(*batch.columns):
                key = page_id.as_py(), digest.as_py()
                if not page.as_py():
                    decided = key, first.as_py()
                    continue
                refers = decided[1] if decided and decided[0] == key else None
                writer.add(shard.as_py(), page_record(key[0], url.as_py(), payload.as_py(), refers))
        writer.close()
        yield from _to_batches(writer.rows, _MANIFEST)

    written = sorted_rows.select("page_id", "url", "payload", "digest", "first", "page", "shard").mapInArrow(write, MANIFEST)
    written.write.parquet(f"{folder}/written")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = files_of(folder)
        for batch in batches:
            for row in batch.to_pylist():
                # A repeated task finds the file under its final name already.
                if fs.get_file_info(f"{path}/{row['temporary']}").type != pafs.FileType.NotFound:
                    fs.move(f"{path}/{row['temporary']}", f"{path}/{row['name']}")
                if fs.get_file_info(f"{path}/{row['name']}").size != row["bytes"]:
                    raise OSError(f"{row['name']} is not what its writer closed")
            yield batch

    spark.read.schema(MANIFEST).parquet(f"{folder}/written").mapInArrow(commit, MANIFEST).write.parquet(f"{folder}/manifest")
    fs, path = files_of(folder)
    if fs.get_file_info(f"{path}/temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{path}/temporary")  # what is left there is of attempts that were not committed
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").drop("temporary")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    unpack, parts, data = zlib.decompressobj(31), [], stream.read(1 << 20)
    while data:
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
            data = data or stream.read(1 << 20)
        else:
            data = stream.read(1 << 20)
    if any(parts):
        raise ValueError("the file ends within a record")


def parse(member: bytes, file: str) -> tuple | None:
    """A record as a row of RECORD, or None for one that is of no page; digests are checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != "sha1:" + sha1_base32(block):
        raise ValueError(f"a record of {file} does not match its digest")
    kind = headers["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"a payload of {file} does not match its digest")
    number = lambda name: int(headers[name]) if name in headers else None
    url = headers["WARC-Target-URI"]
    return (
        number("X-Page-Id"), None if url == NO_URL else url, kind, number("X-Refers-To-Page-Id"), size, digest,
        payload if kind == "response" else None, file,
    )


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The page records of the manifest's files; a revisit has no payload of its own.

    A file is one task's, read as a stream.  A record that does not match its digests is an error.
    """
    listed = manifest(spark, folder)
    files = max(1, listed.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = files_of(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for member in members(stream):
                        row = parse(member, name)
                        if row is not None:
                            rows.append(row)
                            size += len(member)
                        if size >= BATCH_BYTES:
                            yield from _to_batches(rows, _RECORD)
                            rows, size = [], 0
                yield from _to_batches(rows, _RECORD)

    return listed.select("name").repartition(files, "name").mapInArrow(read, RECORD)


@query("op3_warc")
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = f"{session_folder(spark, 'warc')}/archive"
    write_warc(table(spark, folder, "pages"), archive, least_bytes=0)
    return read_warc(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file")
