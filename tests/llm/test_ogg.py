from __future__ import annotations

import hashlib
import struct
import zlib

import pytest

from ledgerloom.llm import ogg

from .helpers import clashing, documents


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 1 << 31 else 0)) & 0xFFFFFFFF
    return crc


def test_checksum():
    for data in (b"", b"a", b"OggS" * 9, bytes(range(256))):
        assert ogg.checksum(data) == slow_checksum(data)


TEXTS = [None, "", "a", "é" * 31, "x" * 64, "OggS" * 50, "long é" * 60_000, "x" * (ogg.PACKET * 3), "a", "y" * (255 * 64)]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    data = (text or "").encode()
    samples, n, times, pages = ogg.decode(ogg.write(text))
    assert samples == data + bytes(max(64, -(-len(data) // 64) * 64) - len(data)) and n == len(data)
    assert times[-1] == len(samples) / ogg.RATE and times == sorted(times) and pages >= 4
    assert ogg.write(text) == ogg.write(text)


def test_query_contract_and_edges(spark):
    got = {r["doc_id"]: r for r in ogg.features(ogg.media(clashing(documents(spark, TEXTS)))).collect()}
    for i, t in enumerate(TEXTS):
        data, n = ogg.payload(t)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (n, len(data), zlib.crc32(data[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["media_sha256"] == hashlib.sha256(ogg.write(t)).hexdigest()
    assert got[2][1:] == got[8][1:] and got[0][1:] == got[1][1:]
    assert not ogg.features(ogg.media(documents(spark, []).where("false"))).collect()


def test_packets_across_pages_and_exact_multiples():
    packets = [(b"head", 0), (bytes(255 * 300), 10), (bytes(255), 11), (b"", 12), (b"z" * 70_000, 13)]
    s = ogg.read(b"".join(ogg.paginate(packets, 7)))[7]
    assert s.packets == [p for p, _ in packets] and s.granules[-1] == 13 and s.granules[0] == 0


def test_damage_is_found():
    good = ogg.write("hello" * 10_000)
    with pytest.raises(ValueError, match="checksum"):
        ogg.read(good[:200] + bytes([good[200] ^ 1]) + good[201:])
    with pytest.raises(ValueError, match="cut"):
        ogg.read(good[:-1])
    pages = ogg.paginate([(b"h", 0), (bytes(200_000), 5)], 3)
    assert len(pages) > 3
    with pytest.raises(ValueError, match="out of order"):
        ogg.read(b"".join(pages[:2] + pages[3:]))
    with pytest.raises(ValueError, match="cut"):
        ogg.read(b"".join(pages[:-1]))
    with pytest.raises(ValueError, match="no page"):
        ogg.read(b"Rubbish" + struct.pack("<I", 1))
