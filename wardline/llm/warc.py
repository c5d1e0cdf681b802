"""WARC archives: one gzip member per record, written by Spark tasks and read back one member after the other.

Writing. Records with equal payloads of at least `min_bytes` bytes form a group (told apart by their
SHA-256); the one with the smallest page_id is a response, the others are revisits that refer to it. The
smallest ids are a plain aggregate; pages meet them in a join that Spark may split where one payload has
very many pages. A task turns its rows into gzip members and Spark's text sink puts them into files, so
that retries and lost executors are Spark's business and any file system that Spark knows will do. The
sink ends each row with a separator byte. A gzip member ends with the high byte of its length, which is
zero below 16 MiB: a row is a member without that byte, and the separator is the zero byte. Behind a
larger record comes an empty member, which ends in a zero byte again. The files are plain .warc.gz.

Reading. Spark hands whole files to tasks (files hold at most `per_file` records); a task inflates one
member at a time, frames its record by Content-Length and checks block and payload digests. A damaged
member, a wrong length or a wrong digest raises ValueError with the record's place.

Defined results: null html is an empty payload; a null url gives `urn:unknown`; characters that a header
cannot hold are percent-encoded; a null page_id is written as an empty id and read back as null; rows that
repeat a page_id and payload are responses if theirs is the smallest id; an empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm.common import keep
from wardline.sources.staging import shared_folder

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_PRINTABLE = "".join(chr(c) for c in range(33, 127))
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)

RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload binary, "
    "payload_bytes long, payload_digest string, file string, offset long"
)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One uncompressed record; a revisit holds the HTTP header of the response only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda key: f"<urn:page:{'' if key is None else key}>"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "urn:unknown" if url is None else quote(url, safe=_PRINTABLE)),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    header = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return b"%s\r\n%s\r\n%s\r\n\r\n" % (VERSION, header, block)


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte, if need be with an empty member behind it."""
    packed = gzip.compress(data, 6, mtime=0)
    return packed if packed[-1] == 0 else packed + _EMPTY_MEMBER


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, per_file: int = 10_000, date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Write a record per page (page_id, url, html) as .warc.gz files of at most `per_file` records."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("same", F.sha2("payload", 256))
    enough = F.length("payload") >= min_bytes
    firsts = rows.filter(enough).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = keep(firsts.filter("n > 1").select("same", "first"))
    joined = rows.join(firsts, "same", "left").select(
        "page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256).to_pylist()
                packed = [member(record(r["page_id"], r["url"], r["payload"], r["refers_to"], date))[:-1] for r in part]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["row"])

    members = joined.mapInArrow(pack, "row binary").select(F.col("row").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(folder)


def inflated(data: bytes, step: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """Members of a gzip file, one at a time: where each begins, and its bytes. Empty members are passed over."""
    at = 0
    while at < len(data):
        begin, unpack, parts = at, zlib.decompressobj(wbits=31), []
        while not unpack.eof:
            if at >= len(data):
                raise ValueError(f"member at byte {begin} ends too early")
            chunk = data[at : at + step]
            try:
                parts.append(unpack.decompress(chunk))
            except zlib.error as fault:
                raise ValueError(f"member at byte {begin}: {fault}") from fault
            at += len(chunk) - len(unpack.unused_data)
        whole = b"".join(parts)
        if whole:
            yield begin, whole


def parse(data: bytes) -> dict:
    """One record by its framing; digests are checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError("no record header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.decode().partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {size} does not frame the record")
    block = rest[:size]
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("wrong block digest")
    http, found, payload = block.partition(b"\r\n\r\n")
    stated = {k.lower(): v for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")[1:])}
    length, kind = int(stated[b"content-length"]), fields["warc-type"]
    if kind == "response":
        if len(payload) != length or fields["warc-payload-digest"] != f"sha1:{digest(payload)}":
            raise ValueError("wrong payload length or digest")
    number = lambda key: int(text) if (text := fields.get(key, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number("warc-record-id"),
        "url": fields["warc-target-uri"],
        "record_type": kind,
        "refers_to": number("warc-refers-to"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": length,
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
    }


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in a folder; revisits have no payload."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    kinds = spark.createDataFrame([], RECORD).schema
    names = kinds.names
    arrow = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [arrow[f.dataType.simpleString()] for f in kinds]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, rows, held = batch.column(0)[i].as_py(), [], 0
                for offset, data in inflated(batch.column(1)[i].as_py()):
                    try:
                        rows.append(parse(data) | {"file": path, "offset": offset})
                    except (KeyError, ValueError) as fault:
                        raise ValueError(f"{path}, byte {offset}: {fault!r}") from fault
                    held += len(data)
                    if held >= 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    return files.mapInArrow(run, kinds)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder and read these back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, min_bytes)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
