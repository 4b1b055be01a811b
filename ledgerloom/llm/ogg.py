"""Ogg media columns: a container writer and a reader that checks, reassembles, demultiplexes and dates packets.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the samples (8 bits, mono,
``RATE`` a second) of one logical stream. A second stream, multiplexed with it, carries the unpadded length. The
reader verifies each page's checksum, puts packets together from lacing values, also across pages, separates the
streams by serial number and takes times from granule positions, which count samples.

Edge cases: null is the empty text, 64 zero bytes; very long texts are many pages; equal texts give equal bytes,
because serial numbers come from the payload; an empty table gives no rows; only ``doc_id`` and ``text`` are read.
A page with a wrong checksum, a gap in page numbers or a cut file raises ``ValueError``.
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

from .common import arrow

RATE = 8000
UNIT = 64
PACKET = 16_384
#: Packets of samples that begin on one page, at most.
PAGE_SEGMENTS = 255

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_CONTINUED, _FIRST, _LAST = 1, 2, 4


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, start and end 0.

    zlib's is the same polynomial with mirrored bits, so mirrored bytes go in and the mirrored result comes out.
    """
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def paginate(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream. packets: bytes and the granule position at the packet's end; the first has a page of its own."""
    out: list[bytes] = []

    def write(group: list[tuple[bytes, int]], last: bool) -> None:
        lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p, _ in group)
        body = b"".join(p for p, _ in group)
        done, at, k = np.flatnonzero(np.frombuffer(lacing, np.uint8) < 255), 0, 0
        for a in range(0, len(lacing), PAGE_SEGMENTS):
            part = lacing[a : a + PAGE_SEGMENTS]
            k = int(np.searchsorted(done, a + len(part)))  # packets that end up to here
            granule = group[k - 1][1] if k and done[k - 1] >= a else -1
            flags = (_CONTINUED if a and lacing[a - 1] == 255 else 0) | (_FIRST if not out else 0)
            flags |= _LAST if last and a + PAGE_SEGMENTS >= len(lacing) else 0
            n = sum(part)
            out.append(_page(flags, granule, serial, len(out), part, body[at : at + n]))
            at += n

    write(packets[:1], len(packets) == 1)
    if packets[1:]:
        write(packets[1:], True)
    return out


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  #: of the page on which each packet ends; -1 but for a page's last
    number: int = 0
    part: list[bytes] = field(default_factory=list)
    ended: bool = False


def read(data: bytes) -> dict[int, Stream]:
    """The logical streams of an Ogg file by serial number."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or len(data) < at + 27:
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc = struct.unpack_from("<4sBBqIII", data, at)
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            raise ValueError(f"bad or cut page at byte {at}")
        if checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        if (serial not in streams) != bool(flags & _FIRST):
            raise ValueError(f"stream {serial} begins wrongly at byte {at}")
        s = streams.setdefault(serial, Stream())
        if number != s.number or bool(s.part) != bool(flags & _CONTINUED) or s.ended:
            raise ValueError(f"page {number} of stream {serial} is out of order")
        s.number += 1
        s.ended = bool(flags & _LAST)
        body = at + 27 + n
        before = len(s.packets)
        run = 0
        for value in lacing:
            run += value
            if value < 255:
                s.packets.append(b"".join([*s.part, data[body : body + run]]))
                s.granules.append(-1)
                s.part = []
                body, run = body + run, 0
        if run or (n and lacing[-1] == 255):
            s.part.append(data[body : body + run])
        if len(s.packets) > before:
            s.granules[-1] = granule
        elif granule != -1:
            raise ValueError(f"page {number} of stream {serial} ends no packet but has a granule position")
        at = end
    if any(s.part or not s.ended for s in streams.values()):
        raise ValueError("a stream is cut")
    return streams


def payload(text: str | None) -> tuple[bytes, int]:
    """Padded bytes and the number of bytes before the padding."""
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\0"), len(data)


def write(text: str | None) -> bytes:
    """The Ogg file of a text."""
    samples, n = payload(text)
    serial = zlib.crc32(samples)
    head = b"\x80samples" + struct.pack("<IQ", RATE, len(samples))
    packets = [(head, 0)] + [(samples[a : a + PACKET], min(a + PACKET, len(samples))) for a in range(0, len(samples), PACKET)]
    sound = paginate(packets, serial)
    notes = paginate([(b"\x80notes\0\0", 0), (struct.pack("<Q", n), len(samples))], serial ^ 0xFFFFFFFF)
    # first pages come first, then the streams' pages in turn
    rest = [p for k in range(1, max(len(sound), len(notes))) for s in (sound, notes) for p in s[k : k + 1]]
    return b"".join([sound[0], notes[0], *rest])


def decode(data: bytes) -> tuple[bytes, int, list[float], int]:
    """Samples, unpadded length, the end time in seconds of each packet whose page tells it, and the number of pages."""
    streams = read(data)
    sound = next(s for s in streams.values() if s.packets[0].startswith(b"\x80samples"))
    notes = next(s for s in streams.values() if s.packets[0].startswith(b"\x80notes"))
    rate, n = struct.unpack_from("<IQ", sound.packets[0], 8)
    samples = b"".join(sound.packets[1:])
    if len(samples) != n or sound.granules[-1] != n:
        raise ValueError("the number of samples is not the one declared")
    return samples, struct.unpack("<Q", notes.packets[1])[0], [g / rate for g in sound.granules[1:] if g >= 0], sum(s.number for s in streams.values())


def feature(samples: bytes, times: list[float], pages: int) -> str:
    """Duration, pages, mean, root mean square, crossings of the mean and the levels of eight equal parts of the sound."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    above = x >= x.mean()
    level = [np.sqrt(np.mean(p * p)) for p in np.array_split(x, 8)]
    parts = [f"{times[-1]:.4f}", str(pages), f"{x.mean():.4f}", f"{np.sqrt(np.mean(x * x)):.4f}", str(int(np.count_nonzero(above[1:] != above[:-1])))]
    return ";".join(parts + [f"{v:.3f}" for v in level])


_FIELDS = {
    "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
}


def media(documents: DataFrame) -> DataFrame:
    """(doc_id, media): each text's Ogg file as a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):  # files are about as long as texts
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write(t) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """One row per media file: what its checked and reassembled samples say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _FIELDS}
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples, n, times, pages = decode(data)
                out["doc_id"].append(doc_id)
                out["n_bytes"].append(n)
                out["payload_bytes"].append(len(samples))
                out["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
                out["tail_crc32"].append(zlib.crc32(samples[-UNIT:]))
                out["media_bytes"].append(len(data))
                out["media_sha256"].append(hashlib.sha256(data).hexdigest())
                out["feature"].append(feature(samples, times, pages))
            yield arrow(_FIELDS, out)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "media").mapInArrow(run, schema)
