"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own. Two skippable frames follow: an index from record identifiers
to (frame, offset in the frame, length), and at the very end the seek table with the sizes of all frames. So one record
is read by decompressing one frame, and any Zstandard tool still reads the whole bundle as a plain WARC file.

A record is named by its page, its payload's digest and a number that tells rows apart that agree in both. So a revisit can
name the response that holds its payload wherever that was written, and reading follows each revisit to its response.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop

#: Bytes of records in a frame and in a bundle, from which the next one begins.
FRAME, BUNDLE = 256 << 10, 16 << 20
# Fixed values of the seekable Zstandard format.
SEEK_TABLE_MAGIC, SEEK_FOOTER_MAGIC, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A51
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(x: str) -> str:
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in x)


def record(record_id: str, url: str | None, digest: str, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response with its HTTP head and payload, or a revisit with the head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to else head + payload
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", _line(url or "")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """(WARC fields, HTTP fields, payload, where the next record begins) of the record at a place."""
    end = data.index(b"\r\n\r\n", at)
    first, *fields = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record here")
    warc = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in fields)
    block = data[end + 4 : end + 4 + int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload, end + 8 + len(block)


class BundleWriter:
    def __init__(self, level: int = 3):
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.sizes, self.frame, self.filled, self.index, self.total = [], [], [], 0, [], 0

    def add(self, record_id: str, data: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.filled, len(data)))
        self.frame.append(data)
        self.filled += len(data)
        self.total += len(data)
        if self.filled >= FRAME:
            self.end_frame()

    def end_frame(self) -> None:
        if self.frame:
            packed = self.zstd.compress(b"".join(self.frame))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.filled))
            self.frame, self.filled = [], 0

    def close(self) -> bytes:
        self.end_frame()
        index = self.zstd.compress(json.dumps(self.index).encode())
        table = b"".join(struct.pack("<II", *x) for x in [*self.sizes, (len(index) + 8, 0)]) + struct.pack("<IBI", len(self.sizes) + 1, 0, SEEK_FOOTER_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", INDEX_MAGIC, len(index)) + index + struct.pack("<II", SEEK_TABLE_MAGIC, len(table)) + table


class BundleReader:
    """Random access to a bundle's records, from its footer."""

    def __init__(self, data: bytes):
        self.data, self.zstd, self.last = data, zstandard.ZstdDecompressor(), (None, b"")
        n, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEK_FOOTER_MAGIC:
            raise ValueError("no seek table")
        at, self.frames = 0, []
        for packed, plain in struct.iter_unpack("<II", data[-9 - 8 * n : -9]):
            self.frames.append((at, packed, plain))
            at += packed
        at, packed, _ = self.frames.pop()  # the index is the last frame of the table
        self.index = {k: (f, o, z) for k, f, o, z in json.loads(self.zstd.decompress(data[at + 8 : at + packed]))}

    def frame(self, n: int) -> bytes:
        if self.last[0] != n:
            at, packed, plain = self.frames[n]
            self.last = n, self.zstd.decompress(self.data[at : at + packed], max_output_size=plain)
        return self.last[1]

    def record(self, record_id: str) -> tuple[dict[str, str], dict[str, str], bytes]:
        f, offset, _ = self.index[record_id]
        return parse(self.frame(f), offset)[:3]


def record_name(page_id: int | None, digest: str, number: int = 0) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{digest}:{number}"


def _write(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, bundle = TaskContext.get().partitionId(), 0, BundleWriter()

        def done():
            return pa.RecordBatch.from_arrays([pa.array([f"{part:05d}-{n:05d}"]), pa.array([bundle.close()], pa.binary())], ["bundle_id", "bundle"])

        for b in batches:
            for page, url, payload, number, refers in zip(*(c.to_pylist() for c in b.columns)):
                payload = (payload or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                name = record_name(page, digest, number)
                bundle.add(name, record(name, url, digest, payload, None if refers is None else record_name(refers, digest), date))
                if bundle.total >= BUNDLE:
                    yield done()
                    n, bundle = n + 1, BundleWriter()
        if bundle.index:
            yield done()

    return run


def write_bundles(pages: DataFrame, html_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Bundles (bundle_id, bundle binary) with a record for each row of pages (page_id, url, html_col).

    The payload is the page in UTF-8, empty for a null. Of equal payloads of at least min_bytes, rows with the smallest page_id
    are responses, all others revisits that name it; a null id is never the smallest unless all are null, and then all are
    responses. Smaller payloads are always responses. Payloads are counted by digest, and both sides of the join that tells
    rows which page has theirs are plain exchanges, so Spark splits a frequent payload. Rows that agree in page_id and payload
    are numbered from 0, in the order of their urls, and the first is the one that revisits name.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).alias("html"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    keyed = rows.withColumn("digest", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    counted = cut(keyed.select("page_id", "digest", size.alias("size")).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("k"), F.max("size").alias("size")), "warc-counted")
    again = counted.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("k").alias("n"), F.max("size").alias("size"), (F.max("k") > 1).alias("twice")).where("n > 1")
    again = cut(again.select("digest", F.when(F.col("size") >= min_bytes, F.col("first")).alias("first"), "twice"), "warc-again")
    told = keyed.join(again, "digest", "left")
    columns = ["page_id", "url", "html", "number", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")]
    out = told.where(~F.coalesce("twice", F.lit(False))).withColumn("number", F.lit(0)).select(*columns)
    if not again.where("twice").isEmpty():
        number = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url")) - 1
        out = out.unionByName(told.where("twice").withColumn("number", number).select(*columns))
    drop(counted)
    return out.mapInArrow(_write(date), "bundle_id string, bundle binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "name", "refers_to_name"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    for b in batches:
        for data in b.column(0):
            bundle, out = BundleReader(data.as_py()), [[] for _ in names]
            for name in bundle.index:
                warc, http, payload = bundle.record(name)
                digest, kind = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"]
                if warc["WARC-Record-ID"] != f"<{name}>":
                    raise ValueError(f"the index leads from {name} to another record")
                if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"the payload of {name} does not fit its digest")
                page = name.split(":")[2]
                refers = warc["WARC-Refers-To"][1:-1] if "WARC-Refers-To" in warc else None
                for column, x in zip(out, (None if page == "null" else int(page), int(http["Content-Length"]), digest, kind, refers and int(refers.split(":")[2]), name, refers)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)


def _checked(digest: str, other: str) -> Column:
    """digest, or an error where a revisit's response is not there or has another payload."""
    lost = F.col("refers_to_name").isNotNull() & ~F.coalesce(F.col(digest) == F.col(other), F.lit(False))
    return F.when(lost, F.raise_error(F.concat(F.lit("no response of that payload: "), F.col("refers_to_name"))).cast("string")).otherwise(F.col(digest))


def read_bundles(bundles: DataFrame) -> DataFrame:
    """What the archives hold: (page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, read by index
    and seek table. Each revisit is followed to the response that it names; one that is not there, or whose payload does not
    fit its digest, is an error."""
    found = cut(bundles.select("bundle").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, name string, refers_to_name string"), "warc-records")
    asked = cut(found.select("refers_to_name").where("refers_to_name is not null").distinct(), "warc-asked")
    responses = found.where("record_type = 'response'").select(F.col("name").alias("refers_to_name"), F.col("payload_digest").alias("there"))
    responses = cut(responses.join(asked, "refers_to_name", "left_semi"), "warc-responses")
    out = found.join(responses, "refers_to_name", "left")
    return out.select("page_id", "payload_bytes", _checked("payload_digest", "there").alias("payload_digest"), "record_type", "refers_to")


def archive(pages: DataFrame, html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes the bundles to the shared folder and reads them back. Empty and very long payloads, null ids and repeated rows are
    records like others; an empty table gives none."""
    return read_bundles(cut(write_bundles(pages, html_col, min_bytes), "warc"))
