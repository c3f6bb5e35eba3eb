"""Ogg media columns: writing and reading pages with checksums, lacing, several logical streams and granule positions.

A payload of 8-bit samples is stored as logical streams of raw PCM (channel k holds samples k, k + channels, ...), whose
pages are interleaved. The reader knows nothing of the writer: it verifies each page's checksum, tells the logical
streams apart by serial number, checks page sequence numbers, reassembles packets from lacing values over pages, and takes times
from granule positions. All of it is a map over rows: no shuffle, memory for one batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load, others, ship

CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
MAGIC = b"PCM8"
STREAM_HEAD = struct.Struct("<4sBBBBIQ")  # magic, version, channel, channels, bits, rate, samples
RATE = 8000
#: The bits of each byte in reverse.
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """Bytes that are not a sound Ogg stream."""


def checksum(page: bytes) -> int:
    """CRC-32 of a page (polynomial 0x04C11DB7, not reflected, initial and final value 0), by zlib's reflected twin."""
    x = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(REVERSED), "big")


def page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def paged(packets: list[tuple[bytes, int]], serial: int, segments: int = 255) -> list[bytes]:
    """The pages of one logical stream; packets with their granule positions. The first packet has a page of its own.

    segments: lacing values a page at most (1 to 255); packets run on over pages.
    """
    if not 1 <= segments <= 255:
        raise ValueError("segments is 1 to 255")
    out: list[bytes] = []
    lacing, body, granule, going_on = bytearray(), bytearray(), NO_GRANULE, False

    def flush(more: bool, last: bool) -> None:
        nonlocal lacing, body, granule, going_on
        flags = CONTINUED * going_on | FIRST * (not out) | LAST * last
        out.append(page(flags, granule, serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, granule, going_on = bytearray(), bytearray(), NO_GRANULE, more

    for k, (packet, at) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        i = j = 0
        while i < len(values):
            if len(lacing) == segments:
                flush(i > 0, False)
            n = min(len(values) - i, segments - len(lacing))
            part = values[i : i + n]
            size = 255 * n if part[-1] == 255 else 255 * (n - 1) + part[-1]
            lacing += part
            body += packet[j : j + size]
            i, j = i + n, j + size
        granule = at
        if k == 0 or k == len(packets) - 1:
            flush(False, k == len(packets) - 1)
    return out


@dataclass
class Stream:
    """A logical stream as read: packets, the granule position known at each packet's end (-1: none), pages, faults."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    sequence: int = -1
    partial: bytearray | None = None
    ended: bool = False
    faults: int = 0

    def times(self, rate: int, samples: Callable[[bytes], int] | None = None) -> list[float | None]:
        """The time at each packet's end. A page tells it for its last packet; with samples (of a packet) the packets before are counted back from there."""
        ends = list(self.granules)
        if samples is not None:
            for k in range(len(ends) - 2, -1, -1):
                if ends[k] < 0 <= ends[k + 1]:
                    ends[k] = max(ends[k + 1] - samples(self.packets[k + 1]), 0)
        return [g / rate if g >= 0 else None for g in ends]


def pages_of(data: bytes, strict: bool = True):
    """(flags, granule, serial, sequence, lacing, body) of each sound page; a bad one is an error, or skipped if not strict."""
    at = 0
    while at < len(data):
        fault = None
        if data[at : at + 4] != CAPTURE:
            fault = "no capture pattern"
        elif at + 27 > len(data):
            fault = "a page header is cut off"
        else:
            _, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(data, at)
            lacing = data[at + 27 : at + 27 + n]
            start = at + 27 + n
            stop = start + sum(lacing)
            if version or len(lacing) < n or stop > len(data):
                fault = "a page is cut off or of an unknown version"
            elif checksum(data[at : at + 22] + bytes(4) + data[at + 26 : stop]) != crc:
                fault = "a page's checksum is wrong"
        if fault is None:
            yield flags, granule, serial, sequence, lacing, data[start:stop]
            at = stop
        elif strict:
            raise OggError(f"{fault} at byte {at}")
        else:
            at = data.find(CAPTURE, at + 1)
            if at < 0:
                return


def demultiplex(data: bytes, strict: bool = True) -> dict[int, Stream]:
    """The logical streams by serial number. Not strict: bad pages are skipped, packets that lose a part are dropped and counted as faults."""
    streams: dict[int, Stream] = {}
    for flags, granule, serial, sequence, lacing, body in pages_of(data, strict):
        if serial not in streams:
            if not flags & FIRST and strict:
                raise OggError(f"stream {serial} does not begin with a first page")
            streams[serial] = Stream()
        s = streams[serial]
        lost = sequence != s.sequence + 1
        going_on = bool(flags & CONTINUED)
        if lost or s.ended or going_on != (s.partial is not None):
            if strict:
                raise OggError(f"page {sequence} of stream {serial} does not follow")
            s.faults += 1
            s.partial = None
        skip = going_on and s.partial is None
        s.sequence, s.pages, s.ended = sequence, s.pages + 1, bool(flags & LAST)
        at, size = 0, 0
        ends = 0
        for v in lacing:
            size += v
            if v < 255:
                part = body[at : at + size]
                at, size = at + size, 0
                if skip:
                    skip = False
                    continue
                s.packets.append(bytes(s.partial) + part if s.partial is not None else part)
                s.granules.append(-1)
                s.partial = None
                ends += 1
        if lacing and lacing[-1] == 255 and not skip:
            s.partial = (s.partial or bytearray()) + body[at:]
        if ends and granule != NO_GRANULE:
            s.granules[-1] = granule
    if strict and any(s.partial is not None or not s.ended for s in streams.values()):
        raise OggError("a stream is cut off")
    return streams


def store(payload: bytes, channels: int = 2, rate: int = RATE, packet: int = 2000) -> bytes:
    """payload (a multiple of channels bytes) as an Ogg file of one logical stream a channel, pages interleaved."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, channels).T
    base = zlib.crc32(payload)
    streams = []
    for c in range(channels):
        own = samples[c].tobytes()
        head = STREAM_HEAD.pack(MAGIC, 1, c, channels, 8, rate, len(own))
        packets = [(head, 0), *((own[i : i + packet], min(i + packet, len(own))) for i in range(0, len(own), packet))]
        streams.append(paged(packets, (base + c) & 0xFFFFFFFF))
    out = [s[0] for s in streams]
    for k in range(1, max(map(len, streams))):
        out += [s[k] for s in streams if k < len(s)]
    return b"".join(out)


def read(data: bytes) -> tuple[bytes, dict]:
    """The payload and features of a file as store() writes it: streams, pages, packets, seconds (from granules), and statistics of the samples."""
    channels: dict[int, tuple[np.ndarray, int]] = {}
    pages = packets = 0
    seconds = 0.0
    for s in demultiplex(data).values():
        magic, version, c, count, bits, rate, n = STREAM_HEAD.unpack(s.packets[0])
        if magic != MAGIC or version != 1 or bits != 8:
            raise OggError("not a stream of 8-bit samples")
        own = np.frombuffer(b"".join(s.packets[1:]), np.uint8)
        if len(own) != n or s.granules[-1] != n:
            raise OggError("samples are missing")
        channels[c] = own, count
        times = s.times(rate, len)
        if times[1:] != [min((k + 1) * len(s.packets[1]), n) / rate for k in range(len(times) - 1)]:
            raise OggError("the granule positions are not the samples' places")
        pages, packets, seconds = pages + s.pages, packets + len(s.packets), max(seconds, times[-1])
    if sorted(channels) != list(range(channels[0][1])):
        raise OggError("a channel is missing")
    samples = np.stack([channels[c][0] for c in sorted(channels)], 1)
    total = samples.sum(0, dtype=np.int64)
    square = (samples.astype(np.int32) ** 2).sum(0, dtype=np.int64)
    turns = (np.diff(samples >= 128, axis=0) != 0).sum(0)
    n = len(samples)
    return samples.tobytes(), {
        "streams": len(channels), "pages": pages, "packets": packets, "seconds": round(seconds, 6),
        "mean": [round(int(x) / n, 4) for x in total], "rms": [round((int(x) / n) ** 0.5, 4) for x in square], "crossings": [int(x) for x in turns],
    }


def payload_of(text: bytes, unit: int = 192) -> bytes:
    """text padded by bytes 32 to a positive multiple of unit."""
    return text + b" " * (-len(text) % unit if text else unit)


def store_documents(docs: DataFrame, text: str = "text", keep: bool = True) -> DataFrame:
    """docs without text, with what the Ogg file of each whole text holds when read back: _n_bytes, _payload_bytes, _payload_sha256,
    _tail_crc32, _media_bytes, _media_sha256, _feature, and with keep the file itself, _media.

    Null text is empty: one unit of spaces. Equal texts have equal files. Other columns may hold null and are passed on;
    repeated rows give repeated rows; an empty table an empty one. A file that does not read back raises.
    """
    ship(docs.sparkSession)
    types = {"_n_bytes": "long", "_payload_bytes": "long", "_payload_sha256": "string", "_tail_crc32": "long", "_media_bytes": "long", "_media_sha256": "string", "_feature": "string"} | ({"_media": "binary"} if keep else {})
    rest = others(docs, text, *types)
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        for b in batches:
            made: dict[str, list] = {c: [] for c in types}
            for t in b.column(text):
                own = (t.as_py() or "").encode()
                media = store(payload_of(own))
                back, f = read(media)
                feature = ";".join(f"{k}={','.join(map(str, v)) if isinstance(v, list) else v}" for k, v in f.items())
                row = (len(own), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, media)
                for c, x in zip(types, row):
                    made[c].append(x)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *(pa.array(v, arrow[types[c]]) for c, v in made.items())], [*rest, *types])

    kinds = [*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), *(f"{c} {t}" for c, t in types.items())]
    return docs.select(*rest, text).mapInArrow(run, ", ".join(kinds))


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store_documents(load(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    return out.toDF(*(c.removeprefix("_") for c in out.columns))


QUERIES = {"op7_ogg_media": op7_ogg_media}
ORACLES: dict[str, str] = {}
