"""MPEG audio columns: a lossless store of bytes in silent frames, and a reader for any MPEG audio stream.

``read_stream`` takes the bytes of an MPEG audio file: it parses a leading ID3v2 tag (unsynchronised ones too) and trailing APEv2 and ID3v1
tags, finds frame headers and resynchronises after junk (a header counts only if it is legal and the next one, or the end, follows where it
says; free-format frames get their size from the distance to the next two headers), reads the variable-bitrate table of the first frame (Xing,
Info or VBRI) with the encoder's delay and padding, verifies the 16-bit checksums of all three layers, and returns the exact duration (played
samples and rate, as integers) and the byte offset of every audio frame.

``write_stream`` stores a payload losslessly: MPEG-2 layer III, 16 kHz, mono, 144 kbit/s, protected. A frame has 576 samples and
648 bytes; its main data is empty (silence), so that the 576 payload bytes stand in its ancillary bytes. An ID3v2 tag holds the
unpadded length, a table frame (Info) the frame and byte counts and 100 seek points, an ID3v1 tag ends the file.

Defined cases: null and empty texts are stored as one frame of padding; texts of any length get as many frames as they need (the
unit is padded with bytes 255, which can't be mistaken for headers since frames are followed by length); repeated rows and null ids
give a row each; an empty table gives an empty table; other columns are not carried. Bytes without any frame give zero frames.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm._frames import map_slices, raw_texts, read

UNIT = 576

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version is 1, layer) and index, Hz by version and index.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
VERSIONS = {0: "2.5", 2: "2", 3: "1"}


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int
    #: Bytes after the checksum that it covers, besides the last two of the header; -1 where they depend on the content.
    covered: int
    channels: int = 1
    #: First subband that both channels share.
    bound: int = 32
    padding: int = 0


@lru_cache(maxsize=4096)
def header(four: bytes, free: int = 0) -> Header | None:
    """The frame header in four bytes; None for illegal ones, and for free format unless ``free`` is its unpadded frame size."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    bits, hertz, padding = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version is None or layer == 4 or bits == 15 or bits == 0 and not free or hertz == 3 or four[3] & 3 == 2:
        return None
    first, mono = version == "1", four[3] >> 6 == 3
    kbits, rate = KBITS[first, layer][bits], HERTZ[version][hertz]
    samples = 384 if layer == 1 else 576 if layer == 3 and not first else 1152
    size = (12000 * kbits // rate + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbits // rate + padding
    if bits == 0:
        size = free + padding * (4 if layer == 1 else 1)
    side = 0 if layer < 3 else (17 if mono else 32) if first else (9 if mono else 17)
    # layer I: four allocation bits a subband and channel, those from the bound of joint stereo on for both channels at once
    bound = 4 * (four[3] >> 4 & 3) + 4 if four[3] >> 6 == 1 else 0 if mono else 32
    covered = side if layer == 3 else -1 if layer == 2 else 16 + bound // 2
    return Header(version, layer, not four[1] & 1, kbits, rate, mono, size, samples, side, covered, 1 if mono else 2, 32 if mono else bound, padding)


# Layer II's bits of allocation by subband, as runs of (bits, subbands).
_ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}


def allocation_bits(h: Header) -> list[int]:
    """Bits of allocation of each subband of a layer II frame: by version, rate and kbit/s a channel."""
    each = h.kbits // h.channels
    if h.version != "1":
        name = "low"
    elif h.kbits and each <= 48:
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if h.rate == 48000 or h.kbits and each <= 80 else "b"
    return [bits for bits, n in _ALLOCATION[name] for _ in range(n)]


def covered_bits(data: bytes, at: int, h: Header) -> int:
    """How many bits after the checksum of a layer II frame it covers: allocation, and two for each channel and subband with any."""
    room = data[at + 6 : at + h.size]
    bits, total = int.from_bytes(room[:64].ljust(64, b"\0"), "big"), 512
    used = choices = 0
    for subband, n in enumerate(allocation_bits(h)):
        shared = subband >= h.bound
        for _ in range(1 if shared else h.channels):
            used += n
            if bits >> (total - used) & ((1 << n) - 1):
                choices += h.channels if shared else 1
    return used + 2 * choices


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = value << 1 ^ (0x8005 if value & 0x8000 else 0)
        table.append(value & 0xFFFF)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    value = 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ _CRC[value >> 8 ^ byte]
    return value


def crc16_bits(data: bytes, n: int) -> int:
    """The checksum of the first ``n`` bits."""
    value = crc16(data[: n // 8])
    for i in range(n // 8 * 8, n):
        bit = data[i // 8] >> (7 - i % 8) & 1
        value = (value << 1 & 0xFFFF) ^ (0x8005 if value >> 15 ^ bit else 0)
    return value


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    first: Header | None = None
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    checked: int = 0
    bad: int = 0
    resyncs: int = 0
    skipped: int = 0
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: list[int] = field(default_factory=list)
    #: Samples that the encoder put before and after the sound.
    delay: int = 0
    ending: int = 0

    @property
    def played(self) -> int:
        return max(0, self.samples - self.delay - self.ending)

    @property
    def duration(self) -> tuple[int, int]:
        """Seconds as a reduced fraction."""
        rate = self.first.rate if self.first else 1
        d = gcd(self.played, rate) or 1
        return self.played // d, rate // d


def _syncsafe(four: bytes) -> int:
    return (four[0] & 127) << 21 | (four[1] & 127) << 14 | (four[2] & 127) << 7 | four[3] & 127


def _text(raw: bytes) -> str:
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(code, "replace").rstrip("\0")


def id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Text frames of a leading tag into ``tags``; the number of bytes that the tag takes."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    major, size = data[3], _syncsafe(data[6:10])
    after = min(len(data), 10 + size + (10 if data[5] & 0x10 else 0))
    if data[5] & 0x80 and major < 4:  # unsynchronised as a whole: a zero byte stands after every 255
        data = data[:10] + data[10 : 10 + size].replace(b"\xff\0", b"\xff")
        size = len(data) - 10
    end, at = min(len(data), 10 + size), 10
    if data[5] & 0x40 and major >= 3:  # extended header
        at += _syncsafe(data[10:14]) if major == 4 else 4 + int.from_bytes(data[10:14], "big")
    names, head = (3, 6) if major == 2 else (4, 10)
    while at + head <= end and data[at]:
        name = data[at : at + names].decode("latin-1")
        raw = data[at + names : at + (6 if major == 2 else 8)]
        n = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        body = data[at + head : min(end, at + head + n)]
        if major == 4:  # frame by frame
            flags = data[at + 9]
            body = body[4:] if flags & 1 else body
            body = body.replace(b"\xff\0", b"\xff") if flags & 2 else body
        if name in ("TXXX", "TXX"):
            key, _, value = _text(body).partition("\0")
            tags[f"{name}:{key}"] = value.lstrip("﻿")
        elif name[0] == "T":
            tags[name] = _text(body)
        at += head + n
    return after


def ape(data: bytes, end: int, tags: dict[str, str]) -> int:
    """Text items of an APEv2 tag that ends at ``end``; the number of bytes that it takes."""
    foot = data[max(0, end - 32) : end]
    if len(foot) < 32 or foot[:8] != b"APETAGEX":
        return 0
    version, size, count, flags = struct.unpack("<IIII", foot[8:24])
    whole = size + (32 if flags >> 31 else 0)
    if not 32 <= size <= end or whole > end:
        return 0
    at, stop = end - size, end - 32
    for _ in range(count):
        if at + 8 > stop:
            break
        n, kind = struct.unpack("<II", data[at : at + 8])
        key_end = data.find(b"\0", at + 8, stop)
        if key_end < 0 or key_end + 1 + n > stop:
            break
        if kind >> 1 & 3 == 0:
            tags[f"ape:{data[at + 8 : key_end].decode('latin-1')}"] = data[key_end + 1 : key_end + 1 + n].decode("utf-8", "replace")
        at = key_end + 1 + n
    return whole


def id3v1(data: bytes, tags: dict[str, str]) -> int:
    """Fields of a trailing tag; the number of bytes that it takes."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return 0
    for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
        if value := data[len(data) - 128 + a : len(data) - 128 + b].split(b"\0")[0].decode("latin-1").strip():
            tags[f"id3v1:{name}"] = value
    return 128


def _bitrate_table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Reads the table if the frame at ``at`` holds one."""
    body = at + 4 + 2 * h.protected + h.side
    frame_end = at + h.size
    for place in {body, at + 4 + h.side}:
        if data[place : place + 4] in (b"Xing", b"Info"):
            out.table, flags = data[place : place + 4].decode(), int.from_bytes(data[place + 4 : place + 8], "big")
            place += 8
            if flags & 1:
                out.table_frames, place = int.from_bytes(data[place : place + 4], "big"), place + 4
            if flags & 2:
                out.table_bytes, place = int.from_bytes(data[place : place + 4], "big"), place + 4
            if flags & 4 and place + 100 <= frame_end:
                out.toc = list(data[place : place + 100])
            place += (100 if flags & 4 else 0) + (4 if flags & 8 else 0)
            if data[place : place + 4] in (b"LAME", b"Lavf", b"Lavc") and place + 24 <= frame_end:
                both = int.from_bytes(data[place + 21 : place + 24], "big")
                out.delay, out.ending = both >> 12, both & 0xFFF
            return True
    place = at + 36
    if data[place : place + 4] == b"VBRI" and place + 26 <= frame_end:
        out.table = "VBRI"
        out.table_bytes, out.table_frames, n, scale, width = struct.unpack(">IIHHH", data[place + 10 : place + 24])
        raw = data[place + 26 : min(frame_end, place + 26 + n * width)]
        out.toc = [scale * int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw), max(1, width))]
        return True
    return False


def _same(a: Header, b: Header) -> bool:
    return (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def _checksum(data: bytes, at: int, h: Header) -> bool | None:
    """Whether the frame's checksum is right; None where it has none."""
    if not h.protected:
        return None
    if h.covered < 0:
        n = covered_bits(data, at, h)
        return crc16_bits(data[at + 2 : at + 4] + data[at + 6 : at + 6 + -(-n // 8)], 16 + n) == int.from_bytes(data[at + 4 : at + 6], "big")
    return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.covered]) == int.from_bytes(data[at + 4 : at + 6], "big")


#: Largest free-format frame: over 640 kbit/s at the lowest rates.
FREE_MOST = 1 << 14


def _free_size(data: bytes, at: int, end: int) -> int:
    """Unpadded size of the free-format frames that begin at ``at``: three headers (or two and the end) that it parts; 0 if there is none."""
    four = data[at : at + 4]
    if len(four) < 4 or four[2] >> 4 or header(four, 4) is None:
        return 0
    h = header(four, 4)
    unit = 4 if h.layer == 1 else 1
    place = at + 4 + 2 * h.protected + max(h.side, 1)
    while 0 <= (place := data.find(four[:2], place, min(end - 3, at + FREE_MOST))):
        if data[place + 2] & 0xFC == four[2] & 0xFC:
            size = place - at - unit * (four[2] >> 1 & 1)
            follows = place + size + unit * (data[place + 2] >> 1 & 1)
            if follows == end or follows + 4 <= end and data[follows : follows + 2] == four[:2] and data[follows + 2] & 0xFC == four[2] & 0xFC:
                return size
        place += 1
    return 0


def read_stream(data: bytes) -> Stream:
    out = Stream()
    at = id3v2(data, out.tags)
    end = len(data) - id3v1(data, out.tags)
    end -= ape(data, end, out.tags)
    free = 0
    synced, begun = True, False
    while at + 4 <= end:
        h = header(data[at : at + 4], free)
        if h is None and not free and not begun and data[at : at + 1] == b"\xff" and header(data[at : at + 4], 4) is not None:
            free = _free_size(data, at, end)
            h = header(data[at : at + 4], free) if free else None
        fits = h is not None and at + h.size <= end and (out.first is None or _same(h, out.first))
        if fits and at + h.size != end:
            after = header(data[at + h.size : at + h.size + 4], free)
            if after is None or not _same(after, h):
                # it leads to no other frame: the last one before junk, if it is in step and its checksum doesn't speak against it
                fits = synced and begun and _checksum(data, at, h) is not False
        if not fits:
            out.resyncs += synced
            synced = False
            near = data.find(b"\xff", at + 1, end)
            near = end if near < 0 else near
            out.skipped += near - at
            at = near
            continue
        synced = True
        if not begun:
            begun, out.first = True, h
            if _bitrate_table(data, at, h, out):
                at += h.size
                continue
        right = _checksum(data, at, h)
        if right is not None:
            out.checked += 1
            out.bad += not right
        out.offsets.append(at)
        out.samples += h.samples
        at += h.size
    out.skipped += max(0, end - at)
    return out


# ---- the lossless store

_HEAD = bytes([0xFF, 0xF2, 13 << 4 | 2 << 2, 0xC0])  # MPEG-2, layer III, protected; 144 kbit/s, 16 kHz; mono
_SIDE = bytes(9)
_LEAD = _HEAD + crc16(_HEAD[2:] + _SIDE).to_bytes(2, "big") + _SIDE
_SIZE = header(_HEAD).size


def _id3(n_bytes: int) -> bytes:
    body = b"\3" + b"payload_bytes\0" + str(n_bytes).encode()
    frame = b"TXXX" + bytes([len(body) >> 21 & 127, len(body) >> 14 & 127, len(body) >> 7 & 127, len(body) & 127]) + b"\0\0" + body
    return b"ID3\4\0\0" + bytes([0, 0, len(frame) >> 7 & 127, len(frame) & 127]) + frame


def pad(raw: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the unit."""
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def write_stream(raw: bytes) -> bytes:
    payload = np.frombuffer(pad(raw), np.uint8).reshape(-1, UNIT)
    n = len(payload)
    frames = np.zeros((n, _SIZE), np.uint8)
    frames[:, : len(_LEAD)] = np.frombuffer(_LEAD, np.uint8)
    frames[:, len(_LEAD) : len(_LEAD) + UNIT] = payload
    size = (n + 1) * _SIZE
    toc = bytes(min(255, 256 * (1 + i * n // 100) * _SIZE // size) for i in range(100))
    table = _LEAD + b"Info" + struct.pack(">III", 7, n & 0xFFFFFFFF, size & 0xFFFFFFFF) + toc
    tail = b"TAG" + b"payload".ljust(30, b"\0") + bytes(95)
    return b"".join((_id3(len(raw)), table.ljust(_SIZE, b"\0"), frames.tobytes(), tail))


def stored_payload(media: bytes, stream: Stream) -> bytes:
    """The payload in the ancillary bytes of the frames that ``write_stream`` made."""
    a = len(_LEAD)
    return b"".join([media[o + a : o + a + UNIT] for o in stream.offsets])


_RESULT = [
    ("media", T.BinaryType()), ("payload", T.BinaryType()), ("n_bytes", T.LongType()), ("frames", T.LongType()), ("samples", T.LongType()), ("rate", T.LongType()),
    ("duration_num", T.LongType()), ("duration_den", T.LongType()), ("bad_checksums", T.LongType()), ("resyncs", T.LongType()), ("table", T.StringType()),
    ("seek_offsets", T.ArrayType(T.LongType(), False)), ("feature", T.StringType()),
]


def feature(s: Stream) -> str:
    if s.first is None:
        return "none"
    num, den = s.duration
    gaps = ",".join(f"{o}" for o in np.unique(np.diff(s.offsets))) if len(s.offsets) > 1 else ""
    places = zlib.crc32(np.array(s.offsets, "<i8").tobytes())
    return (
        f"mpeg{s.first.version} layer{s.first.layer} {s.first.rate}Hz;frames={len(s.offsets)};duration={num}/{den};checksums={s.checked - s.bad}/{s.checked};"
        f"resyncs={s.resyncs};table={s.table}:{s.table_frames}:{s.table_bytes};first={s.offsets[0] if s.offsets else -1};step={gaps};offsets={places:08x}"
    )


def byte_numbers(media: bytes, stream: Stream) -> str:
    """Sum, distinct values and CRC-32 of the payload as it is read back."""
    payload = np.frombuffer(stored_payload(media, stream), np.uint8)
    return f"{int(payload.sum(dtype=np.int64))}/{int((np.bincount(payload, minlength=256) > 0).sum())}/{zlib.crc32(payload.tobytes()):08x}"


def store_audio(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Stores each text as MPEG audio and reads it back: ``keep`` columns, then those of ``_RESULT``."""
    narrow = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*narrow.drop("_text").schema, *(T.StructField(n, t) for n, t in _RESULT)])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        media = [write_stream(raw) for raw in raw_texts(part, "_text")]
        streams = [read_stream(m) for m in media]
        columns = [
            pa.array(media, pa.binary()),
            pa.array([stored_payload(m, s) for m, s in zip(media, streams)], pa.binary()),
            pa.array([int(s.tags["TXXX:payload_bytes"]) for s in streams], pa.int64()),
            pa.array([len(s.offsets) for s in streams], pa.int64()),
            pa.array([s.samples for s in streams], pa.int64()),
            pa.array([s.first.rate if s.first else 0 for s in streams], pa.int64()),
            pa.array([s.duration[0] for s in streams], pa.int64()),
            pa.array([s.duration[1] for s in streams], pa.int64()),
            pa.array([s.bad for s in streams], pa.int64()),
            pa.array([s.resyncs for s in streams], pa.int64()),
            pa.array([s.table for s in streams], pa.string()),
            pa.array([s.offsets for s in streams], pa.list_(pa.int64())),
            pa.array([f"{feature(s)};bytes={byte_numbers(m, s)}" for m, s in zip(media, streams)], pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *columns], schema.names)

    return map_slices(narrow, "_text", work, schema)


def op3_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    stored = store_audio(read(spark, sf_dir, "documents"))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "frames",
        "samples",
        "rate",
        F.crc32(F.array_join(F.col("seek_offsets").cast("array<string>"), ",").cast("binary")).alias("seek_offsets_crc32"),
    )
