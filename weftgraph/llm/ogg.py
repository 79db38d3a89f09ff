"""Ogg media columns: pages with checksums, packets from lacing values, logical
streams, and timestamps from granule positions.

Writing: packets of each logical stream are laced (255s and a final value below
255), cut into pages of at most 255 lacing values, and the pages of all streams
are interleaved, first pages in front.  Reading: every page's checksum is
verified, pages are dealt to their streams by serial number, packets are put
together again across pages from the lacing values, and granule positions give
the time at which each packet ends.  A page whose checksum is wrong is left out
and counted, and reading resumes at the next capture pattern; a packet that has
lost a part is left out.

The checksum is CRC-32 with polynomial 0x04C11DB7, not reflected and without
inversions: on bit-reversed bytes this is zlib's CRC-32, whose inversions cancel.

Texts are stored as unsigned 8-bit mono PCM (OggPCM mapping) next to a second
logical stream that names the unpadded length.

Defined results: null text counts as empty (one block of padding); equal texts
have equal media; texts may be of any length; repeated rows give repeated
results; extra columns are ignored.  Media that are null, or that have lost a page
of their headers or of their data, have null values but for the size and digest of
what is stored and the number of bad pages.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CONTINUED, FIRST, LAST = 1, 2, 4
_PAGE = struct.Struct("<4sBBqIIIB")
_PCM = struct.Struct(">8sHHIIBBHI")  # magic, version, format, rate, bits, channels, frames a packet, extra headers
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
BLOCK = 192  # payloads are padded to a positive multiple
RATE = 48_000
PACKET = 1920  # samples of a data packet


def checksum(data: bytes) -> int:
    """CRC of a page whose checksum field is zero."""
    crc = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def pages(serial: int, groups: list[list[tuple[bytes, int]]]) -> list[bytes]:
    """Pages of one logical stream; each group of (packet, granule position at its end) begins a page."""
    out: list[bytes] = []
    for g, packets in enumerate(groups):
        lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p, _ in packets)
        ends = np.cumsum([len(p) // 255 + 1 for p, _ in packets])  # lacing values up to each packet's end
        body = b"".join(p for p, _ in packets)
        sizes = np.add.reduceat(np.frombuffer(lacing, np.uint8).astype(np.int64), np.arange(0, len(lacing), 255))
        at = 0
        for k, size in enumerate(sizes.tolist()):
            own = lacing[255 * k : 255 * k + 255]
            finished = int(np.searchsorted(ends, 255 * k + len(own), "right"))
            granule = packets[finished - 1][1] if finished and ends[finished - 1] > 255 * k else -1
            kind = CONTINUED * (k > 0 and lacing[255 * k - 1] == 255) | FIRST * (not out) | LAST * (g == len(groups) - 1 and k == len(sizes) - 1)
            head = _PAGE.pack(b"OggS", 0, kind, granule, serial, len(out), 0, len(own)) + own
            page = bytearray(head + body[at : at + size])
            page[22:26] = checksum(bytes(page)).to_bytes(4, "little")
            out.append(bytes(page))
            at += size
    return out


def multiplex(streams: list[list[bytes]]) -> bytes:
    """One physical stream: all first pages, then the rest in turn."""
    first = [s[0] for s in streams]
    rest = [s[1:] for s in streams]
    turns = [p for k in range(max(map(len, rest), default=0)) for s in rest if k < len(s) for p in [s[k]]]
    return b"".join(first + turns)


@dataclass
class Stream:
    """A logical stream as read: packets with the granule position at their end (None: unknown)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _next: int = 0
    _part: list[bytes] | None = None


@dataclass
class Media:
    streams: dict[int, Stream] = field(default_factory=dict)
    bad_pages: int = 0


def demultiplex(data: bytes) -> Media:
    """All logical streams of a physical stream."""
    media, at = Media(), data.find(b"OggS")
    while 0 <= at <= len(data) - _PAGE.size:
        magic, version, kind, granule, serial, number, crc, n = _PAGE.unpack_from(data, at)
        body = at + _PAGE.size + n
        lacing = data[at + _PAGE.size : body]
        end = body + sum(lacing)
        whole = magic == b"OggS" and version == 0 and len(lacing) == n and end <= len(data)
        if not whole or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            media.bad_pages += 1
            at = data.find(b"OggS", at + 4)
            continue
        stream = media.streams.setdefault(serial, Stream(serial))
        if number != stream._next or not kind & CONTINUED:
            stream._part = None  # what was open lost its end
        stream._next, stream.pages, stream.ended = number + 1, stream.pages + 1, bool(kind & LAST)
        lost = bool(kind & CONTINUED) and stream._part is None  # the beginning is missing
        values = np.frombuffer(lacing, np.uint8).astype(np.int64)
        stops = np.flatnonzero(values < 255)
        edges = (body + np.cumsum(values)[stops]).tolist()
        first = len(stream.packets)
        for start, stop in zip([body, *edges[:-1]], edges, strict=False):
            part = data[start:stop]
            if stream._part is not None:
                part = b"".join([*stream._part, part])
                stream._part = None
            if lost:
                lost = False
                continue
            stream.packets.append(part)
            stream.granules.append(None)
        if len(stream.packets) > first:
            stream.granules[-1] = granule if granule >= 0 else None
        if n and values[-1] == 255 and not lost:
            stream._part = [*(stream._part or []), data[edges[-1] if edges else body : end]]
        at = end
        if data[at : at + 4] != b"OggS":
            at = data.find(b"OggS", at)
    return media


def packet_times(stream: Stream, samples: list[int], rate: int) -> list[float | None]:
    """Seconds at which each packet ends: granule positions are given for the last packet
    a page completes; the others follow backwards from the samples in between."""
    out: list[float | None] = [None] * len(stream.packets)
    position: int | None = None
    for i in range(len(stream.packets) - 1, -1, -1):
        if stream.granules[i] is not None:
            position = stream.granules[i]
        if position is not None:
            out[i] = position / rate
            position -= samples[i]
    return out


# -- texts as media ---------------------------------------------------------------
def payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (-len(data) % BLOCK if data else BLOCK)


def store(data: bytes, n_bytes: int) -> bytes:
    """PCM stream of the samples, and a stream that names the unpadded length."""
    serial = zlib.crc32(data)
    head = _PCM.pack(b"PCM     ", 2, 0, 1, RATE, 8, 1, PACKET, 0)
    note = struct.pack("<I", 9) + b"weftgraph" + struct.pack("<I", 0)
    packets = [(data[i : i + PACKET], min(i + PACKET, len(data))) for i in range(0, len(data), PACKET)]
    sound = pages(serial, [[(head, 0)], [(note, 0)], packets])
    length = pages(serial ^ 1, [[(b"length\0\0", 0)], [(str(n_bytes).encode(), len(data))]])
    return multiplex([sound, length])


@dataclass
class Sound:
    samples: bytes
    n_bytes: int
    rate: int
    times: list[float | None]
    media: Media


def load(data: bytes) -> tuple[Sound | None, Media]:
    """Reads what ``store`` wrote; no sound if a page is bad, a stream is missing or does not end."""
    media = demultiplex(data)
    named = {name: s for s in media.streams.values() for name in (b"PCM     ", b"length\0\0") if s.packets and s.packets[0].startswith(name)}
    sound, length = named.get(b"PCM     "), named.get(b"length\0\0")
    if media.bad_pages or sound is None or length is None or not (sound.ended and length.ended) or len(length.packets) < 2:
        return None, media
    rate = _PCM.unpack(sound.packets[0])[4]
    times = packet_times(sound, [0, 0, *(len(p) for p in sound.packets[2:])], rate)
    return Sound(b"".join(sound.packets[2:]), int(length.packets[1]), rate, times, media), media


def feature(sound: Sound) -> str:
    """streams, pages, data packets, microseconds, and of the samples: thousandths of mean and deviation, crossings of the middle."""
    x = np.frombuffer(sound.samples, np.uint8)
    end = next((t for t in reversed(sound.times) if t is not None), 0.0)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    parts = (
        len(sound.media.streams), sum(s.pages for s in sound.media.streams.values()), len(sound.times) - 2, round(end * 1e6),
        round(float(x.mean()) * 1000), round(float(x.std()) * 1000), crossings,
    )
    return ":".join(map(str, parts))


def write_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary): the texts, stored."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                media = [store(data, n) for n, data in map(payload, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, bad_pages)
    from the stored bytes."""
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "bad_pages"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 8
        sound, media = load(data)
        stored = (len(data), hashlib.sha256(data).hexdigest())
        if sound is None:
            return (None, None, None, None, *stored, None, media.bad_pages)
        x = sound.samples
        return sound.n_bytes, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-16:]), *stored, feature(sound), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*map(row, batch.column(1).to_pylist()), strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, types, strict=True))], names=names)

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, bad_pages long"
    return media.select("doc_id", "media").mapInArrow(run, schema)


def packets(media: DataFrame) -> DataFrame:
    """(doc_id, serial, packet, granule, seconds, size, data) of every packet of any Ogg bytes; seconds
    at ``RATE`` and one sample a byte."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (key, s.serial, i, s.granules[i], times[i], len(p), p)
                for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for s in demultiplex(data or b"").streams.values()
                for times in [packet_times(s, [len(p) for p in s.packets], RATE)]
                for i, p in enumerate(s.packets)
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "serial", "packet", "granule", "seconds", "size", "data"])

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, serial long, packet long, granule long, seconds double, size long, data binary")
