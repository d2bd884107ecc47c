"""Operator 13: pages as WARC archives: a deterministic sharded writer that commits by a manifest, and a reader that checks all digests."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import delete, lookup, materialize
from weftline.llm.order import placed

LEAST = 1000  # bytes of a payload from which equal ones are revisits
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = 700  # bytes that a record has besides its payload, about
KEY = ("page_id", "url", "sha256")
FILE = "name string, temporary string, records bigint, bytes bigint, sha256 string"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of the shared folder's address (file, s3, gs, hdfs, abfs), as tasks reach it, and the path in it."""
    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/", 1)[0] else (fs.LocalFileSystem(), folder)


def _base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(repr(parts).encode()).hexdigest()[:32])}>"


def _uri(url: str | None) -> str | None:
    """url as a header field, with white space and control characters, which no valid one has, as percent codes."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One WARC record as a gzip member; fields that are None are left out."""
    lines = [f"{k}: {v}" for k, v in [*fields, ("WARC-Block-Digest", _base32(block)), ("Content-Length", len(block))] if v is not None]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # its header has no time: equal records are equal bytes
    return z.compress("\r\n".join(["WARC/1.1", *lines, "", ""]).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(row: dict, payload: bytes | None, date: str) -> bytes:
    """The response of a page, or its revisit: the response's HTTP header alone. Ids follow from the page, or the place of what is never referred to."""
    revisit = row["revisit"]
    own = _id(row["place"]) if revisit or row["payload_bytes"] < LEAST else _id(*[row[k] for k in KEY])
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", _uri(row["url"])), ("Page-ID", row["page_id"]), ("WARC-Payload-Digest", digest),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(row["first_id"], row["first_url"], row["sha256"])), ("WARC-Refers-To-Target-URI", _uri(row["first_url"])), ("WARC-Refers-To-Date", date), ("Refers-To-Page-ID", row["first_id"])] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(fields, head if revisit else head + payload)


class _File:
    """An archive that is written under a temporary name."""

    def __init__(self, folder: str, shard: int, number: int, date: str) -> None:
        self.name, self.records, self.bytes, self.sha = f"part-{shard:06d}-{number:04d}.warc.gz", 0, 0, hashlib.sha256()
        self.temporary = f"tmp/{self.name}.{uuid.uuid4().hex}"
        system, path = _open(folder)
        system.create_dir(f"{path}/tmp", recursive=True)
        self.out = system.open_output_stream(f"{path}/{self.temporary}", compression=None)
        info = b"format: WARC File Format 1.1\r\n"
        self.put(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id(self.name)), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))

    def put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)

    def close(self) -> tuple:
        self.out.close()
        return self.name, self.temporary, self.records, self.bytes, self.sha.hexdigest()


def _files(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "temporary", "records", "bytes", "sha256"])


def _writer(folder: str, file_bytes: int, date: str):
    """Task: rows by shard and key, the payload (`place` null) before the records of its key, to files of a shard and what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, file, key, payload = None, 0, None, None, None
        for b in batches:
            done, html = [], b.column("html")
            for i, row in enumerate(b.drop_columns(["html"]).to_pylist()):
                own = (row["shard"], *[row[k] for k in KEY])
                if row["place"] is None:
                    key, payload = own, html[i].as_py()
                    continue
                if row["shard"] != shard:
                    if file:
                        done.append(file.close())
                    shard, number, file = row["shard"], 0, None
                elif file.bytes >= file_bytes:
                    done.append(file.close())
                    number, file = number + 1, None
                file = file or _File(folder, shard, number, date)
                small = html[i].as_py()
                if not row["revisit"] and small is None and own != key:
                    raise RuntimeError(f"no payload for page {row['page_id']}")
                file.put(page_record(row, small if small is not None else payload, date))
            if done:
                yield _files(done)
        if file:
            yield _files([file.close()])

    return run


def _order(values: tuple) -> tuple:
    """A key that sorts as Spark sorts rows: null first, strings by their bytes."""
    return tuple((v is not None, v.encode() if isinstance(v, str) else v) for v in values)


def _router(firsts: list[tuple[int, tuple]]):
    """Task: (KEY, html) to rows of their shard, that of the last first key not above theirs; a key that a task has had goes no further.

    Rows of one key may fill several shards; the one that needs the payload, which the others revisit, is the last of them.
    """
    marks = [_order(k) for _, k in firsts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            rows, shards = [], []
            for i, key in enumerate(zip(*[b.column(c).to_pylist() for c in KEY], strict=True)):
                if key not in seen:
                    seen.add(key)
                    rows.append(i)
                    shards.append(firsts[bisect_right(marks, _order(key)) - 1][0])
            part = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shards, pa.int64())], [*b.schema.names, "shard"])

    return run


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """KEY, sha1, payload_bytes, small (a payload of under LEAST bytes), row, revisit, first_id, first_url: each page's record without larger payloads.

    Of equal payloads of LEAST bytes or more the one with the largest page_id (then url, null last) is the response and the
    others revisit it.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(payload).cast("long")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("sha1"), size.alias("payload_bytes"), F.when(size < LEAST, payload).alias("small"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows)
    best = F.max(F.struct("page_id", "url", "row")).alias("best")
    firsts = rows.where(F.col("payload_bytes") >= LEAST).groupBy("sha256").agg(best, F.count("*").alias("rows")).where("rows > 1")
    firsts = materialize(firsts.select("sha256", "rows", F.col("best.page_id").alias("first_id"), F.col("best.url").alias("first_url"), F.col("best.row").alias("first_row")))
    return lookup(rows, firsts, "sha256", "rows", "row").withColumn("revisit", F.coalesce(F.col("first_row") != F.col("row"), F.lit(False))).drop("first_row", "rows")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = 16 << 20, most_shards: int = 100_000, file_bytes: int = 256 << 20, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of pages to gzipped WARC files in the shared `folder`; returns the manifest (name, records, bytes, sha256).

    Records are sorted by page_id, url and payload digest and numbered over all ranges; a shard is an interval of about
    shard_bytes of them (more where there were over most_shards), whatever partitions Spark had, so that a rerun writes the
    same bytes. A task writes its shards' files under temporary names and goes on to a new one at file_bytes of compressed
    data. The names that succeeded tasks return are renamed, which may be repeated, and only then is the manifest written;
    what lost or doubled attempts left behind is in no manifest and goes.

    Payloads are shuffled once, to the shard that their key's place among the shards' first keys names, and only those of
    LEAST bytes or more. A null html is an empty payload, a null url no Target-URI, a null page_id no Page-ID, first in
    order. Repeated rows are records each; equal ones of LEAST bytes or more revisit the last of them. An empty table
    gives no file; other columns are ignored.
    """
    spark = pages.sparkSession
    small = materialize(records(pages, id_col, url_col, html_col).withColumn("size", F.when(F.col("revisit"), 0).otherwise(F.col("payload_bytes")) + HEAD))
    total = small.agg(F.sum("size")).first()[0] or 0
    each = max(shard_bytes, -(-total // most_shards))
    held = materialize(placed(small, [], [*KEY, "row"], ["size"]).withColumn("shard", F.floor((F.col("size_upto") - 1) / each).cast("long")).drop("size", "size_upto", "row"))
    firsts = held.groupBy("shard").agg(F.min_by(F.struct(*KEY), "place").alias("k")).orderBy("shard").collect()  # at most most_shards rows
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    large = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.sha2(payload, 256).alias("sha256"), payload.alias("html")).where(F.octet_length("html") >= LEAST)
    large = large.mapInArrow(_router([(r["shard"], tuple(r["k"])) for r in firsts]), "page_id bigint, url string, sha256 string, html binary, shard bigint")
    lines = held.withColumnRenamed("small", "html").unionByName(large, allowMissingColumns=True)
    dealt = lines.repartition("shard").sortWithinPartitions("shard", *[F.col(k).asc_nulls_first() for k in KEY], F.col("place").asc_nulls_first())
    staged = materialize(dealt.mapInArrow(_writer(folder, file_bytes, date), FILE), path=f"{folder}/staged")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        for b in batches:
            for name, temporary in zip(b.column("name").to_pylist(), b.column("temporary").to_pylist(), strict=True):
                if system.get_file_info(f"{path}/{temporary}").type != fs.FileType.NotFound:  # else an attempt before has renamed it
                    system.move(f"{path}/{temporary}", f"{path}/{name}")
            yield b

    manifest = materialize(staged.repartition("name").mapInArrow(rename, FILE).drop("temporary"), path=f"{folder}/manifest")
    delete(spark, f"{folder}/staged")
    delete(spark, f"{folder}/tmp")
    return manifest


def _members(stream, sha) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one record each, without holding more than one."""
    z, out = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        sha.update(data)
        while data:
            out.append(z.decompress(data))
            data = z.unused_data if z.eof else b""
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("an archive ends within a record")


def _parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or _base32(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
    return fields, block


def _reader(folder: str, payloads: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["html"] if payloads else [])]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if payloads else [])]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for name, sha256 in zip(b.column("name").to_pylist(), b.column("sha256").to_pylist(), strict=True):
                sha, rows, held = hashlib.sha256(), [], 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for member in _members(stream, sha):
                        fields, block = _parsed(member)
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        if kind == "response" and (len(payload) != size or _base32(payload) != fields["WARC-Payload-Digest"]):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                        url = fields.get("WARC-Target-URI")
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        rows.append((number(fields.get("Page-ID")), url, size, digest, kind, number(fields.get("Refers-To-Page-ID")), *([payload if kind == "response" else None] if payloads else [])))
                        held += len(payload) * payloads + 200
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)
                if sha.hexdigest() != sha256:
                    raise ValueError(f"{name} is not the file of the manifest")

    return run


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and html as bytes, null for revisits) of each record of the manifest's files.

    Files are read as streams, a record at a time. Sizes and digests of payloads and blocks are computed anew and held
    against the headers, and those of files against the manifest; what differs is an error.
    """
    kinds = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", html binary" * payloads
    manifest = spark.read.schema("name string, records bigint, bytes bigint, sha256 string").parquet(f"{folder}/manifest")
    return manifest.repartition(min(max(1, manifest.count()), 10_000), "name").mapInArrow(_reader(folder, payloads), kinds)


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, strlen(html) >= 1000 AND row_number() OVER w > 1 AS again, first_value(page_id) OVER w AS first_id FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST))
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM r
"""
