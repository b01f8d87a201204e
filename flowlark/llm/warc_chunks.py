"""WARC archives through a chunked record table.

A record is rows (record id, chunk number): each chunk is a WARC segment of at
most ``CHUNK_CHARS`` characters that carries the digest of all bytes so far.
Oversized payloads thus pass through writer and reader a chunk at a time: the
writer cuts chunks from the bytes of the Arrow column and hands them on in
batches of bounded size.  Spark itself holds a page's html as one value.
Chunks are written by Spark's text sink, whose row end is the record end that
WARC asks for, as gzip files that one task each reads back in order.

Equal payloads are found by digest: the record with the largest page id is the
response, the others are revisit records that refer to it and have no block.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtools import SLICE_BYTES
from .shared import materialize, new_path

CHUNK_CHARS = 256 * 1024
#: Smaller payloads are always responses.
MIN_REVISIT_BYTES = 0
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + _END
_DATE = "1970-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    """Bare upper-case base32."""
    return base64.b32encode(digest).decode().rstrip("=")


def payload_digests(pages: DataFrame) -> DataFrame:
    """``page_id, key, payload_bytes, payload_digest``, with ``key`` a hash of the html."""
    rows = pages.select("page_id", F.col("html").cast("string").alias("html")).withColumn(
        "key", F.xxhash64(F.coalesce("html", F.lit("")))
    )
    schema = T.StructType(
        [
            rows.schema["page_id"],
            T.StructField("key", T.LongType()),
            T.StructField("payload_bytes", T.LongType()),
            T.StructField("payload_digest", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = pc.cast(pc.fill_null(batch["html"], ""), pa.binary())
            digests = [base32(hashlib.sha1(x.as_buffer()).digest()) for x in html]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["key"], pc.cast(pc.binary_length(html), pa.int64()), pa.array(digests, type=pa.string())],
                names=["page_id", "key", "payload_bytes", "payload_digest"],
            )

    return rows.mapInArrow(run, schema)


def decide(digests: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds ``record_type`` and ``refers_to`` to distinct rows of :func:`payload_digests`."""
    last = digests.groupBy("payload_digest").agg(F.max("page_id").alias("last"))
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("last"))
    return digests.join(last, "payload_digest").select(
        *digests.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("last")).alias("refers_to"),
    )


def _chunks(data: pa.Buffer | bytes, chunk_chars: int) -> Iterator[tuple[str, bool]]:
    """Consecutive texts of ``chunk_chars`` characters in UTF-8 bytes, and whether each is the last; at least one."""
    view, at = memoryview(data), 0
    while True:
        # a character has 4 bytes at most; one that the window cuts is behind the chunk
        chunk = codecs.utf_8_decode(view[at : at + 4 * chunk_chars], "strict", False)[0][:chunk_chars]
        at += len(chunk.encode())
        yield chunk, at >= len(view)
        if at >= len(view):
            return


def _record_id(page_id: object, row: dict) -> str:
    """The record of a page with the payload of ``row``; pages of one payload differ by their id alone."""
    name = f"{page_id}\n{row['key']}\n{row['payload_digest']}"
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}"


def _segments(row: dict, html: pa.Buffer | bytes, chunk_chars: int) -> Iterator[tuple[str, int, str]]:
    """The chunk rows (record id, chunk number, text of the segment) of a page."""
    record, total = _record_id(row["page_id"], row), 0
    running = hashlib.sha1()
    chunks = _chunks(b"" if row["record_type"] == "revisit" else html, chunk_chars)
    for number, (chunk, last) in enumerate(chunks, 1):
        running.update(chunk.encode())
        head = ["WARC/1.1"]
        block = chunk
        if number == 1:
            head += [f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{record}>"]
            if row["url"]:
                head.append("WARC-Target-URI: " + " ".join(row["url"].split()))
            if row["page_id"] is not None:
                head.append(f"X-Page-Id: {row['page_id']}")
            head.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
            head.append(f"X-Payload-Bytes: {row['payload_bytes']}")
            if row["record_type"] == "revisit":
                head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                head.append(f"WARC-Refers-To: <{_record_id(row['refers_to'], row)}>")
                head.append(f"X-Refers-To-Page-Id: {row['refers_to']}")
                block = ""
            else:
                block = _HTTP + chunk
        else:
            head += ["WARC-Type: continuation", f"WARC-Record-ID: <{record}/{number}>", f"WARC-Segment-Origin-ID: <{record}>"]
        head.append(f"WARC-Date: {_DATE}")
        total += len(block.encode())
        if number > 1 or not last:
            head.append(f"WARC-Segment-Number: {number}")
        if number > 1 and last:
            head.append(f"WARC-Segment-Total-Length: {total}")
        if last:
            head.append(f"X-Last-Segment: {number}")
        head.append(f"X-Running-Digest: sha1:{base32(running.copy().digest())}")
        head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
        yield record, number, "\r\n".join(head) + _END + block


def _bounded(rows: Iterator[tuple[str, int, str]], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The chunk rows in batches of about ``limit`` characters, of one row at least."""
    held: list[tuple[str, int, str]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in held], type=t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))],
            names=["record_id", "chunk", "value"],
        )

    for row in rows:
        if held and size + len(row[2]) > limit:
            yield batch()
            held, size = [], 0
        held.append(row)
        size += len(row[2])
    if held:
        yield batch()


def chunk_table(pages: DataFrame, decisions: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``record_id, chunk, value``: the records of the pages, a row for each chunk."""
    rows = pages.select(
        F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).withColumn("key", F.xxhash64(F.coalesce("html", F.lit(""))))
    known = decisions.select(F.col("page_id").alias("d_id"), F.col("key").alias("d_key"), "payload_bytes", "payload_digest", "record_type", "refers_to")
    same = rows["page_id"].eqNullSafe(F.col("d_id")) & (rows["key"] == F.col("d_key"))
    joined = rows.join(known, same).drop("d_id", "d_key")
    schema = "record_id string, chunk int, value string"

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[str, int, str]]:
        html = batch["html"]
        others = [n for n in batch.schema.names if n != "html"]
        for i in range(batch.num_rows):
            yield from _segments({n: batch[n][i].as_py() for n in others}, html[i].as_buffer() or b"", chunk_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _bounded(rows_of(batch))

    return joined.mapInArrow(run, schema)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, chunk_chars: int = CHUNK_CHARS) -> str:
    """Write the pages as WARC files under ``path``."""
    digests = materialize(payload_digests(pages).distinct(), "warc-digests")
    rows = chunk_table(pages, decide(digests, min_bytes), chunk_chars)
    rows.select("value").write.option("lineSep", _END).option("compression", "gzip").text(path)
    return path


class _Reader:
    """Records of one archive from consecutive parts of it."""

    def __init__(self, where: str):
        self.where, self.buffer, self.need, self.head, self.record = where, bytearray(), None, {}, None

    def feed(self, part: bytes) -> Iterator[dict]:
        self.buffer += part
        while True:
            if self.need is None:
                end = self.buffer.find(b"\r\n\r\n")
                if end < 0:
                    return
                lines = bytes(self.buffer[:end]).decode().split("\r\n")
                if lines[0] != "WARC/1.1":
                    raise ValueError(f"no WARC record at a record's place in {self.where}")
                self.head = dict(x.split(": ", 1) for x in lines[1:])
                del self.buffer[: end + 4]
                self.need = int(self.head["Content-Length"])
            if len(self.buffer) < self.need + 4:
                return
            block = bytes(self.buffer[: self.need])
            if self.buffer[self.need : self.need + 4] != b"\r\n\r\n":
                raise ValueError(f"a record of {self.where} doesn't end where its length says")
            del self.buffer[: self.need + 4]
            self.need = None
            if done := self._segment(block):
                yield done

    def _segment(self, block: bytes) -> dict | None:
        kind = self.head["WARC-Type"]
        if kind != "continuation":
            self.record = {"head": self.head, "sha1": hashlib.sha1(), "bytes": 0}
            if kind == "response":
                block = block[block.index(b"\r\n\r\n") + 4 :]
        now = self.record
        now["sha1"].update(block)
        now["bytes"] += len(block)
        if "sha1:" + base32(now["sha1"].copy().digest()) != self.head["X-Running-Digest"]:
            raise ValueError(f"a chunk of {self.where} fails its digest")
        if "X-Last-Segment" not in self.head:
            return None
        first = now["head"]
        digest, size = first["WARC-Payload-Digest"].removeprefix("sha1:"), int(first["X-Payload-Bytes"])
        if first["WARC-Type"] == "response":
            if (base32(now["sha1"].digest()), now["bytes"]) != (digest, size):
                raise ValueError(f"a payload of {self.where} fails its digest")
            digest, size = base32(now["sha1"].digest()), now["bytes"]
        return {
            "page_id": first.get("X-Page-Id"),
            "url": first.get("WARC-Target-URI"),
            "payload_bytes": size,
            "payload_digest": digest,
            "record_type": first["WARC-Type"],
            "refers_to": first.get("X-Refers-To-Page-Id"),
            "record_id": first["WARC-Record-ID"].strip("<>"),
            "n_chunks": int(self.head["X-Last-Segment"]),
        }


_RECORD = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, n_chunks long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record, with digests of what was read; a damaged archive fails."""
    rows = spark.read.option("lineSep", _END).text(path).select(
        F.col("_metadata.file_path").alias("path"), "value"
    )
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            found = []
            for where, part in zip(batch["path"], batch["value"], strict=True):
                where = where.as_py()
                if reader is None or reader.where != where:
                    if reader is not None and (reader.buffer or reader.need is not None):
                        raise ValueError(f"{reader.where} is cut short")
                    reader = _Reader(where)
                found += reader.feed(part.as_py().encode() + b"\r\n\r\n")
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[n] for x in found], type=pa.int64() if n in ("payload_bytes", "n_chunks") else pa.string()) for n in names],
                names=names,
            )
        if reader is not None and (reader.buffer or reader.need is not None):
            raise ValueError(f"{reader.where} is cut short")

    return rows.mapInArrow(run, _RECORD)


def archive_round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Write every page as a WARC record and read the archives back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to,
    url, record_id, n_chunks``.  A null html is an empty payload; empty
    payloads are equal to each other; an empty table leaves empty archives.
    Rows that repeat a page id and payload get records of the same kind.  A
    page without an id can't be referred to: it is a response only where no
    equal payload has an id.  Other columns are not read.
    """
    spark = pages.sparkSession
    path = write_archives(pages, new_path(spark, "warc"), min_bytes, chunk_chars)
    kind = pages.schema["page_id"].dataType
    found = read_archives(spark, path)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "n_chunks"
    )
