"""MPEG audio as a column: frames, tags, durations, seek offsets, lossless payload.

``parse`` reads MPEG-1, 2 and 2.5 audio of layers I to III. It skips ID3v2 tags,
takes a frame header only where the frame's end is followed by a like header, a
tag or the end of the data, searches byte by byte for the next one after damage,
verifies the checksums of protected layer III frames (those of layers I and II
cover fields that only decoding finds, and are not verified), reads Xing, Info and
VBRI tables and ID3 tags, and gives the exact duration as samples over the sample rate and the
byte offset of every audio frame.

``store`` puts any bytes into a valid silent stream: layer III, 48 kHz, one
channel, checksummed, 576 payload bytes a frame as ancillary data behind side
information that announces no audio, preceded by a tag and an Info table. ``load``
reads them back.

Payloads are padded with byte 255 to a positive multiple of 576. Null and empty
texts give one frame of padding. Anything may follow or precede the frames;
damaged frames are counted, and bytes that belong to no frame are skipped; so are
free-format frames, whose headers do not say their size. Data
without any frame have no frames, duration 0 and no offsets; null data give null. Repeated rows
are stored each; extra columns are not read. An empty table gives
no rows; a text of any length is one stream.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.common import pieces

UNIT = 576
#: Fixed values of the format: kilobits a second by (MPEG-1?, layer), Hz of MPEG-1.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ (0x8005 if crc & 0x8000 else 0)
        table.append(crc & 0xFFFF)
    return table


_CRC = _crc_table()


@functools.lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ byte]
    return crc


@dataclass(frozen=True)
class Header:
    """A frame header's fields; ``kind`` is what all frames of a stream share."""

    kind: tuple[int, int, int]
    layer: int
    rate: int
    kbps: int
    channels: int
    size: int
    samples: int
    protected: bool
    side: int


@functools.lru_cache(maxsize=4096)
def header(data: bytes) -> Header | None:
    """The four bytes as a header, or None."""
    if len(data) < 4 or data[0] != 0xFF or data[1] & 0xE0 != 0xE0:
        return None
    version, layer = data[1] >> 3 & 3, 4 - (data[1] >> 1 & 3)
    bitrate, rate = data[2] >> 4, data[2] >> 2 & 3
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3 or data[3] & 3 == 2:
        return None
    first = version == 3
    hz = RATES[rate] >> (0 if first else 1 if version == 2 else 2)
    kbps = BITRATES[first, layer][bitrate]
    padding = data[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12_000 * kbps // hz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + padding
    channels = 1 if data[3] >> 6 == 3 else 2
    side = 0 if layer != 3 else (32 if channels == 2 else 17) if first else (17 if channels == 2 else 9)
    return Header((version, layer, hz), layer, hz, kbps, channels, size, samples, not data[1] & 1, side)


@dataclass
class Audio:
    """What ``parse`` finds."""

    rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)
    bad_checksums: int = 0
    skipped: int = 0

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _synchsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def _text(data: bytes) -> str:
    if not data:
        return ""
    coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[0], "latin-1")
    return data[1:].decode(coding, "replace").rstrip("\0")


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads a tag's text frames; the place after it."""
    major, flags = data[at + 3], data[at + 5]
    end = at + 10 + _synchsafe(data[at + 6 : at + 10])
    p = at + 10
    if flags & 0x40 and p + 4 <= end:
        p += _synchsafe(data[p : p + 4]) if major == 4 else 4 + int.from_bytes(data[p : p + 4], "big")
    while major in (3, 4) and p + 10 <= min(end, len(data)) and data[p : p + 4].isalnum():
        name, raw = data[p : p + 4].decode("ascii"), data[p + 4 : p + 8]
        size = _synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        body = data[p + 10 : min(p + 10 + size, end)]
        if name == "TXXX":
            key, _, value = _text(body).partition("\0")
            tags[f"TXXX:{key}"] = value
        elif name[0] == "T":
            tags[name] = _text(body)
        p += 10 + size
    return end + (10 if flags & 0x10 else 0)


def _table(frame: bytes, head: Header) -> dict[str, object] | None:
    """A Xing, Info or VBRI table in the first frame."""
    at = 4 + 2 * head.protected + head.side
    name = frame[at : at + 4]
    if name in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags = int.from_bytes(frame[at + 4 : at + 8], "big")
        out: dict[str, object] = {"kind": name.decode()}
        at += 8
        for bit, key, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                raw = frame[at : at + size]
                out[key] = list(raw) if size == 100 else int.from_bytes(raw, "big")
                at += size
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        quality, size, frames, entries, scale, width, each = struct.unpack(">HIIHHHH", frame[44:62])
        raw = frame[62 : 62 + entries * width]
        toc = [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw) - width + 1, max(width, 1))] if width else []
        return {"kind": "VBRI", "quality": quality, "bytes": size, "frames": frames, "frames_each": each, "toc": toc}
    return None


def parse(data: bytes) -> Audio:
    """Frames, tags and tables of a stream, found again after any damage."""
    out, p, n = Audio(), 0, len(data)
    kind = None
    end = n
    if n >= 128 and data[n - 128 : n - 125] == b"TAG":
        end = n - 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
            out.tags.setdefault(f"ID3v1:{key}", data[end + a : end + b].split(b"\0")[0].decode("latin-1").rstrip())
    synced = False
    while p < end:
        if data[p : p + 3] == b"ID3" and not synced and p + 10 <= n and not any(x & 0x80 for x in data[p + 6 : p + 10]):
            after = _id3v2(data, p, out.tags)
            if after <= end:
                p = after
                continue
        head = header(data[p : p + 4])
        after = p + head.size if head else 0
        if head and after <= end and (kind is None or head.kind == kind):
            following = header(data[after : after + 4]) if after < end else None
            if after == end or data[after : after + 3] == b"ID3" or following and following.kind == head.kind:
                body = p + 4 + 2 * head.protected
                good = not head.protected or head.layer != 3 or crc16(data[p + 2 : p + 4] + data[body : body + head.side]) == int.from_bytes(data[p + 4 : p + 6], "big")
                if good or synced:
                    out.bad_checksums += not good
                    kind = head.kind
                    table = None if out.offsets or out.table else _table(data[p:after], head)
                    if table:
                        out.table = table
                    else:
                        out.offsets.append(p)
                        out.sizes.append(head.size)
                        out.samples += head.samples
                    out.rate = head.rate
                    p, synced = after, True
                    continue
        synced = False
        found = data.find(b"\xff", p + 1, end)
        tag = data.find(b"ID3", p + 1, end if found < 0 else found)
        to = tag if tag >= 0 else found if found >= 0 else end
        out.skipped += to - p
        p = to
    return out


#: The stored stream's frames: MPEG-1, layer III, checksummed, 224 kbit/s, 48 kHz, one channel.
_HEAD = b"\xff\xfa\xd4\xc0"
_FRAME = header(_HEAD)
_BODY = 4 + 2 + _FRAME.side


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT))


def _tag(name: str, text: str) -> bytes:
    body = b"\x03" + text.encode()
    return name.encode() + len(body).to_bytes(4, "big") + b"\0\0" + body


#: Side information by frame number modulo 32, kept in its five private bits, with its checksum.
_SIDES = []
for _number in range(32):
    # Nine bits of main_data_begin, then the five private bits.
    _side = (_number << 8 * _FRAME.side - 14).to_bytes(_FRAME.side, "big")
    _SIDES.append(crc16(_HEAD[2:] + _side).to_bytes(2, "big") + _side)
_SIDES_ARRAY = np.frombuffer(b"".join(_SIDES), dtype=np.uint8).reshape(32, -1)


def store(payload: bytes) -> bytes:
    """A stream that holds a payload of whole units."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    units = len(payload) // UNIT
    frames = np.zeros((units, _FRAME.size), dtype=np.uint8)
    frames[:, :4] = np.frombuffer(_HEAD, dtype=np.uint8)
    frames[:, 4:_BODY] = _SIDES_ARRAY[np.arange(units) % 32]
    frames[:, _BODY : _BODY + UNIT] = np.frombuffer(payload, dtype=np.uint8).reshape(units, UNIT)
    tags = _tag("TSSE", "korrel payload") + _tag("TXXX", f"crc32\0{zlib.crc32(payload):08x}")
    size = len(tags)
    tag = b"ID3\x03\0\0" + bytes(size >> s & 0x7F for s in (21, 14, 7, 0)) + tags
    total = (units + 1) * _FRAME.size
    toc = bytes(min(255, 256 * ((units * i // 100 + 1) * _FRAME.size) // total) for i in range(100))
    info = b"Info" + struct.pack(">III", 7, units, total) + toc
    first = (_HEAD + _SIDES[0] + info).ljust(_FRAME.size, b"\0")
    return b"".join((tag, first, frames.tobytes()))


def load(data: bytes) -> tuple[bytes, Audio]:
    """The payload of a stored stream, checked, and what was parsed."""
    audio = parse(data)
    whole = np.frombuffer(data, dtype=np.uint8)
    offsets = np.array(audio.offsets, dtype=np.int64)
    payload = whole[(offsets + _BODY)[:, None] + np.arange(UNIT)].tobytes() if len(offsets) else b""
    if audio.bad_checksums or audio.skipped or audio.tags.get("TXXX:crc32") != f"{zlib.crc32(payload):08x}" or audio.table.get("frames") != len(offsets):
        raise ValueError("the stored stream is damaged")
    return payload, audio


def feature(payload: bytes, audio: Audio) -> str:
    """Exact duration, frames, a digest of the seek offsets, and the level of eight equal parts of the samples."""
    samples = np.abs(np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128)
    edges = np.arange(9) * len(samples) // 8
    sums = np.concatenate(([0], np.cumsum(samples)))[edges]
    levels = (sums[1:] - sums[:-1]) // np.maximum(edges[1:] - edges[:-1], 1)
    seek = zlib.crc32(np.array(audio.offsets, dtype="<i8").tobytes())
    return f"{audio.samples}/{audio.rate}s;{len(audio.offsets)}f;seek={seek:08x};level={bytes(levels.tolist()).hex()}"


_STORED = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_AUDIO = "sample_rate int, samples long, seconds double, offsets array<long>, tags map<string,string>, vbr_kind string, vbr_frames long, bad_checksums long, skipped long"


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text's bytes, padded, as a stored stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=8 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([store(padded((x or "").encode())) for x in part.column(1).to_pylist()], pa.binary())], schema=_STORED)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """Per stored row: sizes and digests of what is read back, and ``feature``."""

    def one(data: bytes) -> tuple:
        payload, audio = load(data)
        sha = hashlib.sha256
        return len(payload.rstrip(b"\xff")), len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), sha(data).hexdigest(), feature(payload, audio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "media", 8 << 20):
                rows = [one(x) for x in part.column("media").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(_FEATURES)[1:], strict=True))], schema=_FEATURES)

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def probe(table: DataFrame, key: str, column: str) -> DataFrame:
    """(key, audio): what ``parse`` finds in each row of a binary column."""
    kind = pa.struct([("sample_rate", pa.int32()), ("samples", pa.int64()), ("seconds", pa.float64()), ("offsets", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string())), ("vbr_kind", pa.string()), ("vbr_frames", pa.int64()), ("bad_checksums", pa.int64()), ("skipped", pa.int64())])

    def one(data: bytes | None) -> dict | None:
        if data is None:
            return None
        a = parse(data)
        return {"sample_rate": a.rate, "samples": a.samples, "seconds": a.seconds, "offsets": a.offsets, "tags": list(a.tags.items()), "vbr_kind": a.table.get("kind"), "vbr_frames": a.table.get("frames"), "bad_checksums": a.bad_checksums, "skipped": a.skipped}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "media", 8 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([one(x) for x in part.column(1).to_pylist()], kind)], names=["key", "audio"])

    return table.select(F.col(key).cast("string").alias("key"), F.col(column).cast("binary").alias("media")).mapInArrow(run, f"key string, audio struct<{_AUDIO.replace(' ', ':').replace(',:', ',')}>")
