"""Operator 6: MPEG audio columns.

``parse`` reads any MPEG audio stream: it skips ID3v2 tags, finds frame headers (two consistent headers in a row, so
that a sync pattern inside audio data is no frame), resynchronises after junk, reads Xing/Info and VBRI tables,
verifies the CRC-16 of protected Layer III frames and returns exact durations and the byte offset of every frame.
``store`` writes bytes as such a stream: MPEG-2 Layer III frames of 576 samples whose side information is zero
(decoders play silence) and whose main-data area carries 576 payload bytes each, behind an ID3v2 tag and an Info
frame with the frame count, byte count and seek table.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodechain.llm.common import append_columns

# Fixed values of ISO 11172-3 and 13818-3: kbit/s by (version 1, layer), and Hz of version 1.
KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)

UNIT = 576
#: MPEG-2, Layer III, protected; 144 kbit/s at 16 kHz, no padding; mono. Such a frame has 648 bytes.
HEADER = bytes((0xFF, 0xF2, 0xD8, 0xC0))
FRAME = 648
SIDE = 9
DATA_AT = 4 + 2 + SIDE


def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return tuple(out)


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


@dataclass(frozen=True)
class Header:
    """What one frame header says."""

    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    samples: int
    length: int
    side: int

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.rate


@lru_cache(maxsize=4096)
def header(b: bytes) -> Header | None:
    """The frame header in four bytes, or None (free format is not framed and counts as none)."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version = {0: "2.5", 2: "2", 3: "1"}.get(b[1] >> 3 & 3)
    layer = 4 - (b[1] >> 1 & 3)
    bit, rate = b[2] >> 4, b[2] >> 2 & 3
    if version is None or layer == 4 or bit in (0, 15) or rate == 3 or b[3] & 3 == 2:
        return None
    one = version == "1"
    hz = RATES[rate] >> {"1": 0, "2": 1, "2.5": 2}[version]
    kbps, pad, mono = KBPS[one, layer][bit], b[2] >> 1 & 1, b[3] >> 6 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and not one else 1152
    length = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    side = ((17 if mono else 32) if one else (9 if mono else 17)) if layer == 3 else 0
    return Header(version, layer, not b[1] & 1, kbps, hz, mono, samples, length, side)


@dataclass
class Stream:
    """A parsed stream. ``offsets``: of each audio frame; ``skipped``: bytes that belong to no tag and no frame."""

    head: Header | None = None
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    samples: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict = field(default_factory=dict)
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0
    resyncs: int = 0

    @property
    def duration(self) -> Fraction:
        return Fraction(self.samples, self.head.rate) if self.head else Fraction(0)


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Length of an ID3v2.3/2.4 tag at the start, and its text frames."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0, {}
    end, at, tags = min(len(data), 10 + _syncsafe(data[6:10])), 10, {}
    while at + 10 <= end and data[at : at + 4].isalnum():
        size = _syncsafe(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(end, at + 10 + size)]
        if data[at : at + 1] == b"T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            tags[data[at : at + 4].decode()] = body[1:].decode(code, "replace").rstrip("\0")
        at += 10 + size
    return end, tags


def _vbr(frame: bytes, h: Header) -> dict:
    """The Xing/Info or VBRI table in a first frame; empty if there is none."""
    for at in {4 + h.side, 6 + h.side}:
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, p, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
            for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    out[name] = list(frame[p : p + size]) if name == "toc" else int.from_bytes(frame[p : p + size], "big")
                    p += size
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        n, scale, width, per = (int.from_bytes(frame[i : i + 2], "big") for i in (54, 56, 58, 60))
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(n)]
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "toc": toc, "frames_per_entry": per}
    return {}


def parse(data: bytes | None) -> Stream:
    """Parse a stream. Null, empty or frameless data give a stream without frames; a truncated last frame counts as
    skipped bytes, a protected frame whose CRC disagrees is counted in ``crc_bad`` and kept. TAG at byte -128 begins an
    ID3v1 tag unless it lies in a frame that ends where the data end."""
    data = data or b""
    at, tags = _id3v2(data)
    s, end = Stream(tags=tags), len(data)
    tagged = end - at >= 128 and data[-128:-125] == b"TAG"
    end -= 128 * tagged
    lost, first = False, True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if tagged and not lost and h is not None and at + h.length == len(data) and (s.head is None or h.kind == s.head.kind):
            tagged, end = False, len(data)
        fits = h is not None and at + h.length <= end and (s.head is None or h.kind == s.head.kind)
        if fits and (s.head is None or lost) and at + h.length < end:
            following = header(data[at + h.length : at + h.length + 4])
            fits = following is not None and following.kind == h.kind
        if not fits:
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            s.skipped += found - at
            s.resyncs += not lost
            at, lost = found, True
            continue
        lost = False
        s.head = s.head or h
        if h.protected and h.layer == 3:
            ok = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(data[at + 4 : at + 6], "big")
            s.crc_ok += ok
            s.crc_bad += not ok
        table = _vbr(data[at : at + h.length], h) if first else {}
        first = False
        if table:
            s.vbr = table
        else:
            s.offsets.append(at)
            s.lengths.append(h.length)
            s.samples += h.samples
        at += h.length
    s.skipped += end - at if at < end else 0
    if tagged:
        s.tags.setdefault("TIT2", data[-125:-95].rstrip(b"\0 ").decode("latin-1"))
    return s


def pad(data: bytes) -> bytes:
    """The payload: ``data`` and bytes 255 up to a positive multiple of ``UNIT``."""
    return data + b"\xff" * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def _protected(body: bytes) -> bytes:
    return HEADER + crc16(HEADER[2:] + body[:SIDE]).to_bytes(2, "big") + body


_TAG = b"ID3\x04\0\0" + bytes((0, 0, 0, 24)) + b"TSSE" + bytes((0, 0, 0, 14)) + b"\0\0\3" + b"byte carrier\0"
_TAIL = bytes(FRAME - DATA_AT - UNIT)


def store(payload: bytes) -> bytes:
    """A playable stream that carries ``payload``, whose length must be a positive multiple of ``UNIT``."""
    n = len(payload) // UNIT
    total = (n + 1) * FRAME
    toc = bytes(min(255, 256 * ((n * i // 100 + 1) * FRAME) // total) for i in range(100))
    info = bytes(SIDE) + b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    before = _protected(bytes(SIDE))
    frames = [before + payload[i * UNIT : (i + 1) * UNIT] + _TAIL for i in range(n)]
    return _TAG + _protected(info.ljust(FRAME - 6, b"\0")) + b"".join(frames)


def load(media: bytes, s: Stream | None = None) -> bytes:
    """The payload that ``store`` put into a stream, read frame by frame at the parsed offsets."""
    s = s or parse(media)
    view = memoryview(media)
    return b"".join(view[o + 4 + 2 * s.head.protected + s.head.side :][:UNIT] for o in s.offsets)


STREAM = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("layer", T.IntegerType()),
        T.StructField("rate", T.IntegerType()),
        T.StructField("frames", T.LongType()),
        T.StructField("samples", T.LongType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("offsets", T.ArrayType(T.LongType())),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("vbr_kind", T.StringType()),
        T.StructField("vbr_frames", T.LongType()),
        T.StructField("crc_ok", T.LongType()),
        T.StructField("crc_bad", T.LongType()),
        T.StructField("skipped", T.LongType()),
        T.StructField("resyncs", T.LongType()),
    ]
)


def _row(s: Stream) -> dict:
    h = s.head
    return {
        "version": h and h.version, "layer": h and h.layer, "rate": h and h.rate, "frames": len(s.offsets), "samples": s.samples, "duration_s": float(s.duration),
        "offsets": s.offsets, "tags": s.tags, "vbr_kind": s.vbr.get("kind"), "vbr_frames": s.vbr.get("frames"), "crc_ok": s.crc_ok, "crc_bad": s.crc_bad, "skipped": s.skipped, "resyncs": s.resyncs,
    }


def parse_column(df: DataFrame, media: str = "media", out: str = "stream") -> DataFrame:
    """``df`` with a struct that describes each stream, frame offsets included. Null data: a stream without frames."""
    return append_columns(df, lambda b: [[_row(parse(x)) for x in b[media].to_pylist()]], [T.StructField(out, STREAM)], [media])


def store_column(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with each whole text (null: empty) stored as a stream. Equal texts give equal streams."""
    return append_columns(df, lambda b: [[store(pad((x or "").encode())) for x in b[text].to_pylist()]], [T.StructField(media, T.BinaryType())], [text])


def feature(s: Stream) -> str:
    """A short description: format, exact duration, frames, table, CRC results and a digest of all seek offsets."""
    h, d = s.head, s.duration
    seek = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in s.offsets))
    return f"mpeg{h.version}-layer{h.layer};{h.rate}Hz;{d.numerator}/{d.denominator}s;frames={len(s.offsets)};{s.vbr.get('kind')}={s.vbr.get('frames')};crc={s.crc_ok}+{s.crc_bad};seek={seek:08x}"


def digest_column(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with digests of the payload as read back from each stream, and of the stream itself."""

    def run(b):
        rows = []
        for m in b[media].to_pylist():
            s = parse(m)
            p = load(m, s)
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(s)))
        return list(zip(*rows, strict=True)) or [[]] * 6

    long, text = T.LongType(), T.StringType()
    kinds = {"payload_bytes": long, "payload_sha256": text, "tail_crc32": long, "media_bytes": long, "media_sha256": text, "feature": text}
    return append_columns(df, run, [T.StructField(k, v) for k, v in kinds.items()], [media])
