"""Media columns: Ogg physical streams (RFC 3533) written to and read from a binary column.

``encode`` deals the unsigned 8-bit samples of a payload to two logical streams
(even frames and odd frames), chained page by page into one physical stream;
``read_pages`` verifies the checksum of every page, ``demultiplex`` reassembles
packets from the lacing values stream by stream, and granule positions give the
time stamps.  A page that fails its checksum or a gap in the page sequence
raises ``OggError``; ``decode_column`` turns that into a null payload with the
reason, so one damaged row doesn't end a job.

Null and empty texts are one frame of padding; text length is unbounded (a
payload of any size becomes as many pages as it takes).  Repeated rows each get
their own stream, equal for equal texts; there are no ties.  Kept columns may have
any name but that of a result; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.kernels import text_chunks

#: Samples of a frame (one packet), of a second, and the byte that fills the last frame.
FRAME, RATE, FILL = 576, 48_000, 255
#: Frames on a page: 85 packets of 576 bytes take all of the 255 lacing values.
PAGE_FRAMES = 85
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, no reflection, zero start and no final inversion.

    zlib has the reflected form of the same polynomial: bits of each byte are
    reversed going in and those of the register coming out.
    """
    register = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(_REVERSED), "big")


def write_page(packets: list[bytes], flags: int, granule: int, serial: int, sequence: int) -> bytes:
    """One page with whole packets; the lacing values must fit the 255 segments."""
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes((len(p) % 255,)) for p in packets)
    return _page(lacing, b"".join(packets), flags, granule, serial, sequence)


def _page(lacing: bytes, body: bytes, flags: int, granule: int, serial: int, sequence: int) -> bytes:
    if len(lacing) > 255:
        raise OggError("a page has at most 255 segments")
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def write_stream(packets: Iterable[tuple[bytes, int]], serial: int, per_page: int = PAGE_FRAMES) -> list[bytes]:
    """Pages of one logical stream from (packet, granule position at its end).

    Packets longer than a page can hold go on over as many pages as they need;
    pages on which no packet ends carry the granule position -1.
    """
    pages: list[tuple[bytes, bytes, int, int]] = []
    lacing, body, granule, flags, n = bytearray(), bytearray(), -1, 0, 0

    def close(going_on: bool) -> None:
        nonlocal lacing, body, granule, flags, n
        pages.append((bytes(lacing), bytes(body), flags, granule))
        lacing, body, granule, flags, n = bytearray(), bytearray(), -1, CONTINUED if going_on else 0, 0

    for packet, at in packets:
        values = b"\xff" * (len(packet) // 255) + bytes((len(packet) % 255,))
        if n and len(lacing) + len(values) > 255:
            close(False)
        done = 0
        while values:
            room = 255 - len(lacing)
            part, values = values[:room], values[room:]
            size = sum(part)
            lacing += part
            body += packet[done : done + size]
            done += size
            if values:
                close(True)
        granule, n = at, n + 1
        if n >= per_page or len(lacing) == 255:
            close(False)
    if lacing or not pages:
        close(False)
    out = []
    for k, (lace, data, flag, at) in enumerate(pages):
        flag |= (FIRST if k == 0 else 0) | (LAST if k == len(pages) - 1 else 0)
        out.append(_page(lace, data, flag, at, serial, k))
    return out


def encode(payload: bytes) -> bytes:
    """Frames alternate between two logical streams; their pages alternate in the physical one.

    The granule position of a page is the number of samples of the whole
    payload up to the end of its last frame, so both streams share one clock.
    """
    n = len(payload) // FRAME
    streams = []
    for serial in (0, 1):
        streams.append(write_stream((((payload[k * FRAME : (k + 1) * FRAME]), (k + 1) * FRAME) for k in range(serial, n, 2)), serial) if serial < n else [])
    out = [p[0] for p in streams if p]  # every first page comes before any other page
    for k in range(1, max(map(len, streams))):
        out += [p[k] for p in streams if k < len(p)]
    return b"".join(out)


@dataclass
class Packet:
    serial: int
    data: bytes
    granule: int  #: of the page on which it ends if it is the last to end there, else -1


@dataclass
class Logical:
    serial: int
    sequence: int = 0
    rest: list[bytes] = field(default_factory=list)
    ended: bool = False


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(serial, sequence, flags, granule, lacing, body) of each page, its checksum verified."""
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < HEAD.size:
            raise OggError("cut off in a page header")
        magic, version, flags, granule, serial, sequence, crc, segments = HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError("no page starts here")
        lacing = media[at + HEAD.size : at + HEAD.size + segments]
        body_at = at + HEAD.size + segments
        end = body_at + sum(lacing)
        if end > len(media):
            raise OggError("cut off in a page")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError("checksum")
        yield serial, sequence, flags, granule, lacing, view[body_at:end]
        at = end


def demultiplex(media: bytes) -> Iterator[Packet]:
    """Packets of all logical streams, in the order in which they end."""
    streams: dict[int, Logical] = {}
    for serial, sequence, flags, granule, lacing, body in read_pages(media):
        if flags & FIRST:
            if serial in streams:
                raise OggError("a stream starts twice")
            streams[serial] = Logical(serial)
        s = streams.get(serial)
        if s is None or s.ended or sequence != s.sequence:
            raise OggError("a page is missing")
        if bool(flags & CONTINUED) != bool(s.rest):
            raise OggError("a packet is missing its start or its rest")
        s.sequence += 1
        spans, at, start = [], 0, 0
        for value in lacing:
            at += value
            if value < 255:
                spans.append((start, at))
                start = at
        for k, (a, b) in enumerate(spans):
            s.rest.append(bytes(body[a:b]))
            data = s.rest[0] if len(s.rest) == 1 else b"".join(s.rest)
            s.rest = []
            yield Packet(serial, data, granule if k == len(spans) - 1 else -1)
        if start < at:
            s.rest.append(bytes(body[start:at]))
        s.ended = bool(flags & LAST)
    if any(s.rest or not s.ended for s in streams.values()):
        raise OggError("a stream doesn't end")


def decode(media: bytes) -> tuple[bytes, list[tuple[float, float]]]:
    """The payload, and for each logical stream the time stamps in seconds of its first and last frame's end.

    A page's granule position belongs to its last packet; those before it on
    the page lie two frames apart (the other stream has the frame between).
    """
    by: dict[int, list[bytes]] = {}
    ends: dict[int, list[int]] = {}
    open_: dict[int, int] = {}
    for p in demultiplex(media):
        by.setdefault(p.serial, []).append(p.data)
        open_[p.serial] = open_.get(p.serial, 0) + 1
        if p.granule >= 0:
            n = open_.pop(p.serial)
            ends.setdefault(p.serial, []).extend(range(p.granule - 2 * FRAME * (n - 1), p.granule + 1, 2 * FRAME))
    if open_:
        raise OggError("packets without a time stamp")
    frames: dict[int, bytes] = {}
    for serial, packets in by.items():
        for data, at in zip(packets, ends[serial], strict=True):
            frames[at] = data
    order = sorted(frames)
    if order != list(range(FRAME, FRAME * len(order) + 1, FRAME)):
        raise OggError("time stamps don't follow each other")
    return b"".join(frames[at] for at in order), [(ends[s][0] / RATE, ends[s][-1] / RATE) for s in sorted(ends)]


def to_payload(text: bytes) -> bytes:
    """Bytes 255 are appended up to a positive multiple of a frame."""
    return text + bytes([FILL]) * (-len(text) % FRAME if text else FRAME)


def feature(payload: bytes, times: list[tuple[float, float]]) -> str:
    """Duration, mean and root mean square (over 8-bit samples), crossings of the middle, loudest frame, streams."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    energy = (x * x).reshape(-1, FRAME).sum(axis=1)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return (
        f"samples={len(x)};last_us={round(1e6 * max(t for _, t in times))};sum={int(x.sum())};energy={int(energy.sum())};"
        f"crossings={crossings};loudest={int(energy.argmax())};streams={len(times)}"
    )


def encode_column(df: DataFrame, text: str = "text", media: str = "media", size: str = "n_bytes") -> DataFrame:
    """Adds the Ogg form of a text column, and the unpadded size; columns that already have these names are replaced."""
    df = df.drop(media, size)
    fields = df.select("*", F.lit(0).cast("long").alias(size), F.lit(b"").alias(media)).schema

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text):
            raw = [(t or "").encode() for t in batch.column(text).to_pylist()]
            stored = pa.array([encode(to_payload(t)) for t in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(t) for t in raw], pa.int64()), stored], names=[*batch.schema.names, size, media])

    return df.mapInArrow(write, fields)


DECODED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def decode_column(df: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """Reads a column of Ogg streams back: digests, features and, for a damaged one, the error."""
    kept = df.select(*keep, media)
    names = [x.split()[0] for x in DECODED.split(", ")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != media), DECODED])

    def one(stored: bytes | None) -> tuple:
        if stored is None:
            return None, None, None, None, None, None, "null"
        sha = hashlib.sha256(stored).hexdigest()
        try:
            payload, times = decode(stored)
        except OggError as e:
            return None, None, None, len(stored), sha, None, str(e)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), sha, feature(payload, times), None

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, media):
            rows = [one(x.as_py()) for x in batch.column(media)]
            out = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *out], names=[*keep, *names])

    return kept.mapInArrow(read, schema)
