import hashlib
import random
import struct
import zlib

import pytest

from korrel.llm import media


def test_headers():
    h = media.header(b"\xff\xfb\x90\x00")  # MPEG-1 layer III 128 kbit/s 44.1 kHz
    assert (h.layer, h.rate, h.kbps, h.size, h.samples, h.channels, h.protected, h.side) == (3, 44100, 128, 417, 1152, 2, False, 32)
    assert media.header(b"\xff\xfb\x92\x00").size == 418
    assert media.header(b"\xff\xf3\x80\xc0").size == 208  # MPEG-2 layer III 64 kbit/s 22.05 kHz
    assert media.header(b"\xff\xff\x94\x00").size == 384 * 1000 * 288 // 8 // 48000 // 4 * 4
    for bad in (b"\xff\xfb\xf0\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\x9c\x00", b"\xff\xeb\x90\x00", b"\xff\xf9\x90\x00", b"\xfe\xfb\x90\x00", b"\xff\xfb"):
        assert media.header(bad) is None


def test_checksum():
    assert media.crc16(b"123456789") == 0xAEE7  # the published check value of CRC-16/CMS


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 50_000])
def test_round_trip(size):
    rng = random.Random(size)
    data = bytes(rng.choice([0xFF, 0xFB, 0xFA, 0xD4, 0xC0, 0x49, 0x44, 0x33, rng.randrange(256)]) for _ in range(size))
    payload = media.padded(data)
    assert len(payload) % 576 == 0 and payload[: len(data)] == data and len(payload) - len(data) <= 576
    stored = media.store(payload)
    back, audio = media.load(stored)
    assert back == payload
    units = len(payload) // 576
    assert audio.samples == 1152 * units and audio.rate == 48000 and audio.seconds == units * 0.024
    assert audio.table["kind"] == "Info" and audio.table["frames"] == units
    assert [stored[o : o + 4] for o in audio.offsets] == [b"\xff\xfa\xd4\xc0"] * units


def test_padding():
    assert media.padded(b"") == b"\xff" * 576
    assert media.padded(b"x" * 576) == b"x" * 576


def frame(head, fill=0, **parts):
    h = media.header(head)
    side = bytes(h.side)
    crc = media.crc16(head[2:] + side).to_bytes(2, "big") if h.protected else b""
    body = head + crc + side + parts.get("body", b"")
    return body.ljust(h.size, bytes([fill]))


def test_frames_are_found_again_after_damage():
    a = frame(b"\xff\xfa\x90\x00", 0x55)
    stream = a * 5 + b"\xff\xfb\x00junk\xff\xff" * 9 + a * 4
    found = media.parse(stream)
    assert len(found.offsets) == 9 - 1 or len(found.offsets) == 9
    assert found.offsets[:4] == [i * len(a) for i in range(4)]
    assert found.offsets[-4:] == [len(stream) - (4 - i) * len(a) for i in range(4)]
    assert found.skipped == len(stream) - len(found.offsets) * len(a)


def test_a_bad_checksum_is_counted():
    a = bytearray(frame(b"\xff\xfa\x90\x00") * 6)
    a[3 * 417 + 10] ^= 1
    found = media.parse(bytes(a))
    assert (len(found.offsets), found.bad_checksums) == (6, 1)


def test_tags_and_tables():
    text = b"\x03Title"
    tag = b"ID3\x03\0\0" + bytes((0, 0, 0, 10 + len(text))) + b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text
    head = b"\xff\xfb\x90\x00"
    xing = frame(head, body=b"Xing" + struct.pack(">III", 7, 3, 417 * 4) + bytes(range(100)))
    old = b"TAG" + b"Old title".ljust(30, b"\0") + bytes(95)
    found = media.parse(tag + xing + frame(head) * 3 + old)
    assert found.tags["TIT2"] == "Title" and found.tags["ID3v1:title"] == "Old title"
    assert found.table["kind"] == "Xing" and found.table["frames"] == 3 and found.table["toc"] == list(range(100))
    assert len(found.offsets) == 3 and found.samples == 3 * 1152 and found.skipped == 0
    vbri = bytearray(frame(head))
    vbri[36:62] = b"VBRI" + bytes(4) + struct.pack(">HIIHHHH", 5, 1668, 3, 2, 1, 2, 1)
    vbri[62:66] = struct.pack(">HH", 417, 417)
    found = media.parse(bytes(vbri) + frame(head) * 3)
    assert found.table == {"kind": "VBRI", "quality": 5, "bytes": 1668, "frames": 3, "frames_each": 1, "toc": [417, 417]}


@pytest.mark.parametrize("data", [b"", b"\xff", b"ID3", b"ID3\x03\0\0\x7f\x7f\x7f\x7f", b"text only" * 50, b"\xff\xfb\x90\x00", b"TAG" + bytes(125)])
def test_no_audio(data):
    found = media.parse(data)
    assert not found.offsets and found.seconds == 0


def test_rows(spark, make_docs, corpus):
    texts = [*corpus, "same", "same"]
    rows = {r.doc_id: r for r in media.features(media.store_texts(make_docs(texts))).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
    a, b = rows[len(corpus)], rows[len(corpus) + 1]
    assert a.media_sha256 == b.media_sha256 and a.feature == b.feature
    assert media.features(media.store_texts(make_docs([]))).collect() == []


def test_probe(spark, make_docs):
    stored = media.store_texts(make_docs([(None, "x"), (1, "y" * 2000)])).unionByName(spark.createDataFrame([(2, None), (3, bytearray(b"no audio"))], "doc_id long, media binary"))
    got = {r.key: r.audio for r in media.probe(stored, "doc_id", "media").collect()}
    assert got["2"] is None and got["3"].samples == 0
    assert len(got["1"].offsets) == 4 and got["1"].vbr_frames == 4 and got[None].seconds == 0.024
