"""Media columns: Ogg bitstreams in a binary column.

Decoding verifies every page's checksum and sequence number, demultiplexes
the logical streams by serial number, reassembles packets from lacing values
across pages, and derives timestamps from granule positions.  The encoder
writes the streams that the decoder is tested on: unsigned 8-bit samples, and
beside them a stream of notes on each stretch of samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtools import slices
from .shared import materialize

RATE = 8000
PACKET = 6000
NOTE_EVERY = 65536
ALIGN = 64
_HEAD = struct.Struct("<4sBBqIIIB")  # capture, version, flags, granule, serial, number, checksum, segments
_SAMPLES, _NOTES = b"fpcm8\0\0\0", b"fnotes\0\0"
_MIRROR = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04c11db7, most significant bit first, from 0.

    It is the mirror of zlib's, which works least significant bit first and
    from all ones, over mirrored bytes.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(struct.pack("<I", mirrored).translate(_MIRROR), "big")


class _Stream:
    """Pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def page(self, body: bytes, lacing: bytes, granule: int, flags: int) -> bytes:
        head = _HEAD.pack(b"OggS", 0, flags, granule, self.serial, self.number, 0, len(lacing))
        whole = head + lacing + body
        self.number += 1
        return whole[:22] + struct.pack("<I", page_checksum(whole)) + whole[26:]

    def pages(self, packets: list[tuple[bytes, int]], last: bool) -> Iterator[bytes]:
        """Pages of packets with their granule positions, of at most 255 segments."""
        lacing, body, granule, flags = bytearray(), bytearray(), -1, 0
        for packet, position in packets:
            values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
            at = 0
            while values:
                room = 255 - len(lacing)
                some, values = values[:room], values[room:]
                taken = sum(some)
                lacing += some
                body += packet[at : at + taken]
                at += taken
                if not values:
                    granule = position
                if len(lacing) == 255:
                    end = last and not values and packet is packets[-1][0]
                    yield self.page(bytes(body), bytes(lacing), granule, flags | 4 * end)
                    lacing, body, granule, flags = bytearray(), bytearray(), -1, 1 if values else 0
                    if end:
                        return
        if lacing:
            yield self.page(bytes(body), bytes(lacing), granule, flags | 4 * last)


def encode(payload: bytes) -> bytes:
    """An Ogg file of 8-bit samples, with a second stream of notes; a function of the payload alone."""
    serial = zlib.crc32(payload)
    samples, notes = _Stream(serial), _Stream(serial ^ 0x5A5A5A5A)
    out = [
        b"".join(samples.pages([(_SAMPLES + struct.pack("<IQ", RATE, len(payload)), 0)], False)),
        b"".join(notes.pages([(_NOTES, 0)], False)),
    ]
    out[0], out[1] = (_begun(x) for x in out)
    for start in range(0, len(payload), NOTE_EVERY):
        some = payload[start : start + NOTE_EVERY]
        last = start + NOTE_EVERY >= len(payload)
        cut = [(some[i : i + PACKET], start + min(i + PACKET, len(some))) for i in range(0, len(some), PACKET)]
        note = struct.pack("<II", len(some), zlib.crc32(some))
        out += notes.pages([(note, start + len(some))], last)
        out += samples.pages(cut, last)
    return b"".join(out)


def _begun(page: bytes) -> bytes:
    """The page marked as its stream's first."""
    blank = page[:5] + bytes([page[5] | 2]) + page[6:22] + b"\0\0\0\0" + page[26:]
    return blank[:22] + struct.pack("<I", page_checksum(blank)) + blank[26:]


@dataclass
class Logical:
    """What was found of one logical stream."""

    serial: int
    number: int = 0
    ended: bool = False
    pages: int = 0
    partial: bytearray = field(default_factory=bytearray)
    open: bool = False
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)


def decode(media: bytes) -> dict[int, Logical]:
    """The logical streams of an Ogg file by serial number; ValueError where it is damaged."""
    streams: dict[int, Logical] = {}
    at = 0
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise ValueError("a page is cut short")
        capture, version, flags, granule, serial, number, checksum, n = _HEAD.unpack_from(media, at)
        if capture != b"OggS" or version:
            raise ValueError("no page at a page's place")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise ValueError("a page is cut short")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != checksum:
            raise ValueError("a page fails its checksum")
        if flags & 2:
            if serial in streams:
                raise ValueError("two streams of one serial number")
            streams[serial] = Logical(serial)
        stream = streams.get(serial)
        if stream is None or stream.ended or number != stream.number:
            raise ValueError("a page is missing or out of order")
        if bool(flags & 1) != stream.open:
            raise ValueError("a packet lacks a part")
        body, finished = at + 27 + n, 0
        for value in lacing:
            stream.partial += media[body : body + value]
            body += value
            stream.open = value == 255
            if not stream.open:
                stream.packets.append(bytes(stream.partial))
                stream.partial = bytearray()
                finished += 1
        if (granule >= 0) != bool(finished):
            raise ValueError("a granule position stands on a page that ends no packet, or lacks on one that does")
        stream.granules += [-1] * (finished - 1) + [granule] * bool(finished)
        stream.number, stream.pages, stream.ended = number + 1, stream.pages + 1, bool(flags & 4)
        at = end
    if any(not s.ended or s.open for s in streams.values()):
        raise ValueError("a stream isn't ended")
    return streams


def samples_of(streams: dict[int, Logical]) -> tuple[bytes, str]:
    """The payload of the sample stream, checked against its header and notes, and its features."""
    by_kind = {s.packets[0][:8]: s for s in streams.values()}
    data, notes = by_kind[_SAMPLES], by_kind[_NOTES]
    rate, total = struct.unpack("<IQ", data.packets[0][8:])
    payload = b"".join(data.packets[1:])
    if len(payload) != total or data.granules[-1] != total:
        raise ValueError("samples are missing")
    start = 0
    for note, granule in zip(notes.packets[1:], notes.granules[1:], strict=True):
        size, checksum = struct.unpack("<II", note)
        if zlib.crc32(payload[start : start + size]) != checksum or granule != start + size:
            raise ValueError("samples differ from their note")
        start += size
    wave = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    high = wave >= 128
    marks = [g * 1000 // rate for g in data.granules if g > 0]
    values = {
        "ms": total * 1000 // rate,
        "mean": int(wave.sum()) * 1000 // total,
        "energy": int((wave * wave).sum()) // total,
        "crossings": int((high[1:] != high[:-1]).sum()),
        "pages": data.pages,
        "packets": len(data.packets),
        "marks": len(marks),
        "first_mark_ms": marks[0],
    }
    return payload, ",".join(f"{k}={v}" for k, v in values.items())


def padded(data: bytes) -> bytes:
    """With zero bytes up to a positive multiple of ALIGN."""
    return data + b"\0" * (-len(data) % ALIGN or ALIGN * (not data))


def with_media(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as an Ogg file."""
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                data = pc.cast(pc.fill_null(piece["text"], ""), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece["doc_id"],
                        pc.cast(pc.binary_length(data), pa.int64()),
                        pa.array([encode(padded(x.as_py())) for x in data], type=pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.mapInArrow(run, schema)


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """What is read back from the media column; other columns stay."""
    kept = [f for f in media.schema if f.name != "media"]
    schema = T.StructType(kept + T.StructType.fromDDL(_FEATURES).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "media"):
                rows = []
                for blob in piece["media"]:
                    blob = blob.as_py()
                    payload, feature = samples_of(decode(blob))
                    rows.append(
                        (
                            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]),
                            len(blob), hashlib.sha256(blob).hexdigest(), feature,
                        )
                    )
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [piece[f.name] for f in kept]
                    + [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)],
                    names=schema.names,
                )

    return media.mapInArrow(run, schema)


def media_round_trip(documents: DataFrame) -> DataFrame:
    """Store every text as media, read it back and describe it.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature``.  A null text is an empty one, whose
    payload is 64 zero bytes.  Equal texts give equal values whatever their
    id; an empty table gives no rows; other columns are not read.
    """
    return media_features(materialize(with_media(documents), "ogg"))
