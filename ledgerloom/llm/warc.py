"""WARC archives: records written and read back, transactions assembled by concurrent-to identifiers; and the query op5.

A capture is three records: a request, its response (or a revisit of an earlier equal payload) and its metadata.
Request and metadata name the response in WARC-Concurrent-To. An archive is a file of gzip members, one for each
record (a record of 16 MB or more takes several). Spark's text sink writes the bytes, so any shared file system
serves: a row is an archive, short of the zero byte that every member under 16 MB ends with, which is the sink's
line separator.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ends_with_application, shared_path, small_batches, stored, table

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which an archive ends; a reader holds one archive. Bytes of a record in one gzip member: the last byte of a member's length stays 0.
FILE_BYTES, MEMBER_BYTES = 16 << 20, (1 << 24) - 1
MIN_BYTES = 0

RECORD_SCHEMA = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, headers map<string,string>, http string, payload binary"


def digest_of(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(hexadecimal: Column) -> Column:
    """The same of a SHA-1 in hexadecimal, as a column: five bytes give eight digits."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def record(fields: dict[str, str], block: bytes) -> bytes:
    """A WARC record with the two line ends that close it, as gzip members."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    data = head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    out = []
    for i in range(0, len(data), MEMBER_BYTES):
        z = zlib.compressobj(3, zlib.DEFLATED, 31)
        out.append(z.compress(data[i : i + MEMBER_BYTES]) + z.flush())
    return b"".join(out)


def record_uri(kind: str, key: object, digest: str) -> str:
    """The identifier of a capture's record; the same at each attempt, so a task that runs again writes the same bytes. Pages that repeat a page_id with another payload have others."""
    return f"<urn:ledgerloom:{kind}:{digest}:{key}>"


def capture_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2026-01-01T00:00:00Z", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(record): the three records of each page, as gzip members. A null html is an empty payload, a null url an empty one.

    Of pages with equal payloads of at least min_bytes bytes the one with the largest page_id is the response, the
    others revisit it; of rows that repeat that page_id and payload each is a response, under one identifier. Rows
    without page_id are left out: nothing could refer to them.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.where(F.col(page_id).isNotNull()).select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "utf-8")))
    owners = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("owner"))
    owners = stored(owners, "owners")  # so that the join has plain shuffles on both sides, of which Spark splits the hot partitions
    rows = rows.join(owners.hint("merge"), "sha", "left").select("page_id", "url", "html", "sha", F.coalesce("owner", "page_id").alias("owner"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for k, u, h, hexadecimal, owner in zip(*(c.to_pylist() for c in b.columns)):
                payload = h.encode("utf-8", "surrogatepass")
                sha = base64.b32encode(bytes.fromhex(hexadecimal)).decode()
                target = clean(u)
                common = {"WARC-Target-URI": target, "WARC-Date": date}
                response = record_uri("response", k, sha)
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                head = {"WARC-Type": "response", "WARC-Record-ID": response, **common, "WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": "application/http; msgtype=response"}
                if owner != k:
                    head |= {"WARC-Type": "revisit", "WARC-Refers-To": record_uri("response", owner, sha), "WARC-Profile": REVISIT_PROFILE}
                host = target.split("/")[2] if target.count("/") >= 2 else ""
                out += [
                    record(head, http if owner != k else http + payload),
                    record({"WARC-Type": "request", "WARC-Record-ID": record_uri("request", k, sha), **common, "WARC-Concurrent-To": response, "Content-Type": "application/http; msgtype=request"}, f"GET {target or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode("utf-8", "surrogatepass")),
                    record({"WARC-Type": "metadata", "WARC-Record-ID": record_uri("metadata", k, sha), **common, "WARC-Concurrent-To": response, "Content-Type": "application/warc-fields"}, f"page-id: {k}".encode()),
                ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return rows.mapInArrow(write, "record binary")


def write_archives(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Archives below path, each ended by the record with which it reaches file_bytes. Spark names the files (*.txt)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(x)
                size += len(x)
                if size >= file_bytes:
                    yield archive(held)
                    held, size = [], 0
        if held:
            yield archive(held)

    def archive(held: list[bytes]) -> pa.RecordBatch:
        data = b"".join(held)
        assert data[-1] == 0  # the separator stands for it
        return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["archive"])

    rows = records.mapInArrow(gather, "archive binary").select(F.col("archive").cast("string"))
    rows.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    ends_with_application(records.sparkSession, path)


def members(data: bytes) -> Iterator[bytes]:
    """The content of each gzip member."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            part = view[at : at + 16384]
            if not len(part):
                raise ValueError("an archive ends within a record")
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(out)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, one record at a time; the block's end is found by its length."""
    held = b""
    for part in members(data):
        held += part
        end = held.find(b"\r\n\r\n")
        if end < 0:
            continue
        lines = held[:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        stop = end + 4 + int(fields["Content-Length"])
        if len(held) < stop + 4:
            continue  # the rest is in the next member
        yield fields, held[end + 4 : stop]
        held = b""
    if held:
        raise ValueError("an archive ends within a record")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """RECORD_SCHEMA: the records of all archives below path. payload: what follows the HTTP header in a response, null in a revisit, the block of other records."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    small_batches(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "headers", "http", "payload"])

        for b in batches:
            for content in b.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                for f, block in parsed(content):
                    kind = f["WARC-Type"]
                    http, payload = "", block
                    if kind in ("response", "revisit", "request"):
                        http, _, payload = (x for x in (block.partition(b"\r\n\r\n")))
                        http = http.decode("utf-8", "surrogatepass")
                    rows.append((f["WARC-Record-ID"], kind, f.get("WARC-Concurrent-To"), f.get("WARC-Refers-To"), f.get("WARC-Target-URI"), f.get("WARC-Date"), f.get("WARC-Payload-Digest"), list(f.items()), http, None if kind == "revisit" else payload))
                    held += len(block)
                    if len(rows) >= 500 or held > FILE_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(read, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: record_id and the nested response, request and metadata (null where a capture has none).

    A capture is a response or revisit record; requests and metadata join it by their concurrent_to. Of several
    requests (or metadata) of a capture the one with the least record_id counts. Records that name no capture are left out.
    """
    rest = [c for c in records.columns if c not in ("record_id", "type", "concurrent_to")]
    captures = records.where(F.col("type").isin("response", "revisit")).select("record_id", F.struct("type", *rest).alias("response"))
    parts = records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    body = F.struct("record_id", *rest)
    parts = parts.groupBy(F.col("concurrent_to").alias("record_id")).agg(*(F.min_by(F.when(F.col("type") == t, body), F.when(F.col("type") == t, F.col("record_id"))).alias(t) for t in ("request", "metadata")))
    return captures.join(parts, "record_id", "left").select("record_id", "response", "request", "metadata")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(capture_records(table(spark, sf_dir, "pages")), path)
    records = read_archives(spark, path)

    records = records.select("record_id", "type", "concurrent_to", "refers_to", F.when(F.col("type") == "metadata", F.col("payload").cast("string")).alias("fields"), F.when(F.col("type") == "response", F.octet_length("payload")).cast("long").alias("n"), F.when(F.col("type") == "response", base32(F.sha1("payload"))).alias("digest"))
    captures = assemble(records)
    page = lambda c: F.regexp_extract(c, r"(\d+|-\d+)\D*$", 1).cast("long")
    captures = stored(captures.select("record_id", page(F.col("metadata.fields")).alias("page_id"), "response.*"), "captures")
    originals = stored(captures.where("type = 'response'").dropDuplicates(["record_id"]), "originals").select(F.col("record_id").alias("refers_to"), F.col("n").alias("of_n"), F.col("digest").alias("of_digest"))
    # responses have their own digest and name no other record: only revisits are joined
    revisits = captures.where("type = 'revisit'").join(originals.hint("merge"), "refers_to", "left")
    responses = captures.where("type = 'response'").select(*captures.columns, F.lit(None).cast("long").alias("of_n"), F.lit(None).cast("string").alias("of_digest"))
    out = responses.unionByName(revisits)
    return out.select("page_id", F.coalesce("n", "of_n").alias("payload_bytes"), F.coalesce("digest", "of_digest").alias("payload_digest"), F.col("type").alias("record_type"), page(F.col("refers_to")).alias("refers_to"))
