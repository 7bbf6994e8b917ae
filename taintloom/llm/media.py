"""MPEG audio columns: frames are found by resynchronising, tags and bit-rate tables parsed, checksums verified.

Also a lossless store: text bytes become the 8-bit samples of MPEG-1 Layer I frames (16 subbands of 12 samples,
192 bytes a frame), behind a tag that keeps the length and a table frame that counts frames and bytes.
UTF-8 has no byte 255, the one sample code that the format forbids.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from taintloom.llm.common import prepare, utf8

UNIT = 192
# Fixed values of the format: kbit/s by version 1 or 2 and layer, sampling rates of version 1
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
# Fixed values of the format: Layer II, how many subbands in a row have allocations of how many bits
ALLOCATIONS = {
    "version 1, 27 subbands": ((11, 4), (12, 3), (4, 2)),
    "version 1, 30 subbands": ((11, 4), (12, 3), (7, 2)),
    "version 1, 8 subbands": ((2, 4), (6, 3)),
    "version 1, 12 subbands": ((2, 4), (10, 3)),
    "version 2": ((4, 4), (7, 3), (19, 2)),
}
#: No frame of free format is longer.
FREE_MOST = 1 << 13


@dataclass(frozen=True)
class Header:
    """What the four bytes of a frame header say."""

    version: float  # 1, 2 or 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int  # bytes of the frame
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


_headers: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The header, or None if it is none; free format counts as none, as its frames have no stated size."""
    h = _loose(four)
    return h if h is not None and h.size else None


def _loose(four: bytes) -> Header | None:
    """The header, one of free format too, with size 0."""
    if four not in _headers:
        if len(_headers) > 10_000:
            _headers.clear()
        _headers[four] = _parse_header(four)
    return _headers[four]


def _parse_header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {3: 1, 2: 2, 0: 2.5}.get(four[1] >> 3 & 3)
    layer = 4 - (four[1] >> 1 & 3)
    rate_index, bits = four[2] >> 2 & 3, four[2] >> 4
    if version is None or layer == 4 or rate_index == 3 or bits == 15 or four[3] & 3 == 2:
        return None
    rate = RATES[rate_index] // (1 if version == 1 else 2 if version == 2 else 4)
    kbps = BITRATES[1 if version == 1 else 2, layer][bits]
    padding = four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    if not bits:
        return Header(version, layer, not four[1] & 1, 0, rate, four[3] >> 6 == 3, 0, samples)
    size = (12 * kbps * 1000 // rate + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + padding
    return Header(version, layer, not four[1] & 1, kbps, rate, four[3] >> 6 == 3, size, samples)


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The frames' checksum: polynomial 8005, from ones."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


_checks: dict[tuple[bytes, int], int] = {}


def _checked(covered: bytes, bits: int) -> int:
    """The checksum of the first bits of these bytes."""
    if (covered, bits) not in _checks:
        if len(_checks) > 10_000:
            _checks.clear()
        crc = crc16(covered[: bits // 8])
        for k in range(bits // 8 * 8, bits):
            one = covered[k >> 3] >> (7 - (k & 7)) & 1
            crc = (crc << 1 ^ (0x8005 if (crc >> 15 & 1) ^ one else 0)) & 0xFFFF
        _checks[covered, bits] = crc
    return _checks[covered, bits]


def _allocations(h: Header) -> tuple[tuple[int, int], ...]:
    """Layer II: the table that rate and bit rate of a channel choose."""
    if h.version != 1:
        return ALLOCATIONS["version 2"]
    each = h.kbps // (1 if h.mono else 2)
    if each <= 48:
        return ALLOCATIONS["version 1, 12 subbands" if h.rate == 32000 else "version 1, 8 subbands"]
    return ALLOCATIONS["version 1, 27 subbands" if h.rate == 48000 or each <= 80 else "version 1, 30 subbands"]


def _covered2(data: bytes, at: int, h: Header) -> int:
    """Layer II: the bits that a checksum covers behind it: allocations, and two for each that is not empty."""
    bits = [n for count, n in _allocations(h) for _ in range(count)]
    joint = data[at + 3] >> 6 == 1
    bound = min(len(bits), 4 * ((data[at + 3] >> 4 & 3) + 1)) if joint else len(bits)
    body = data[at + 6 : at + 6 + 64].ljust(64, b"\0")
    held, place, used = int.from_bytes(body, "big"), 0, 0
    for k, n in enumerate(bits):
        # beyond the bound of joint stereo both channels share an allocation
        for times in (2,) if not h.mono and k >= bound else (1,) * (1 if h.mono else 2):
            used += times * bool(held >> (512 - place - n) & (1 << n) - 1)
            place += n
    return place + 2 * used


def verify(data: bytes, at: int, h: Header) -> bool | None:
    """Whether the frame's checksum holds: over the header's last two bytes and the bit allocation (Layer I), that and
    the choice of scale factors (Layer II) or the side information (Layer III). None without a checksum."""
    if not h.protected:
        return None
    if h.layer == 2:
        bits = _covered2(data, at, h)
    elif h.layer == 1:
        bits = (16 if h.mono else 32) * 8
        if not h.mono and data[at + 3] >> 6 == 1:
            bound = 4 * ((data[at + 3] >> 4 & 3) + 1)
            bits = (2 * bound + 32 - bound) * 4
    else:
        bits = h.side * 8
    stored = int.from_bytes(data[at + 4 : at + 6], "big")
    covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + -(-bits // 8)]
    return len(covered) * 8 >= 16 + bits and _checked(covered, 16 + bits) == stored


@dataclass
class Parsed:
    tags: dict[str, str] = field(default_factory=dict)
    frames: list[int] = field(default_factory=list)  # offsets
    table: dict[str, int] | None = None
    points: list[int] = field(default_factory=list)  # seek points of the table, bytes from its frame on
    samples: int = 0
    rate: int = 0
    microseconds: int = 0
    good: int = 0
    bad: int = 0
    skipped: int = 0
    first: Header | None = None
    rates: set[int] = field(default_factory=set)


def _synchsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _tag2(data: bytes, tags: dict[str, str]) -> int:
    """Text frames of an ID3v2 tag at the start; the number of its bytes."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    major, end = data[3], min(len(data), 10 + _synchsafe(data[6:10]))
    at = 10
    if data[5] & 0x40 and end >= 14:
        at += _synchsafe(data[10:14]) if major == 4 else 4 + int.from_bytes(data[10:14], "big")
    while at + 10 <= end and data[at : at + 4].isalnum():
        name = data[at : at + 4].decode("latin-1")
        n = _synchsafe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(end, at + 10 + n)]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            if name == "TXXX":
                key, _, text = text.partition("\0")
                name = f"TXXX:{key}"
            tags[name] = text
        at += 10 + n
    return end + (10 if data[5] & 0x10 else 0)


def _tag1(data: bytes, tags: dict[str, str]) -> int:
    """An ID3v1 tag at the end; the place where it starts."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return len(data)
    for name, lo, hi in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
        text = data[-128:][lo:hi].rstrip(b"\0 ").decode("latin-1")
        if text:
            tags.setdefault(name, text)
    return len(data) - 128


def _bitrate_table(data: bytes, at: int, h: Header) -> tuple[dict[str, int], list[int]] | None:
    """A Xing, Info or VBRI table in the frame: its counts, and the bytes from this frame to each of its seek points."""
    number = lambda place, n: int.from_bytes(data[place : place + n], "big")
    for base in {at + 4 + h.side, at + 4 + 2 * h.protected + (16 if h.mono else 32) if h.layer == 1 else at + 4 + h.side, at + 4}:
        if data[base : base + 4] in (b"Xing", b"Info") and base + 8 <= at + h.size:
            flags, place, out, points = number(base + 4, 4), base + 8, {}, []
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = number(place, 4)
                    place += 4
            if flags & 4 and place + 100 <= at + h.size:
                points = [share * out.get("bytes", 0) // 256 for share in data[place : place + 100]]
                place += 100
            if flags & 8 and place + 4 <= at + h.size:
                out["quality"] = number(place, 4)
            return out, points
    base = at + 36
    if data[base : base + 4] == b"VBRI" and base + 26 <= at + h.size:
        entries, scale, size = number(base + 18, 2), number(base + 20, 2), number(base + 22, 2)
        points, place = [0], base + 26
        while 0 < size <= 4 and len(points) <= entries and place + size <= at + h.size:
            points.append(points[-1] + number(place, size) * scale)
            place += size
        return {"bytes": number(base + 10, 4), "frames": number(base + 14, 4)}, points[1:] and points
    return None


def _free(data: bytes, at: int, end: int, known: int) -> Header | None:
    """A header of free format, whose frame's size is found: `known` bytes without padding, or up to the next header
    like it where another one, or the end, lies as far behind that."""
    h = _loose(data[at : at + 4])
    if h is None or h.size:
        return None
    unit = 4 if h.layer == 1 else 1
    padding = lambda place: (data[place + 2] >> 1 & 1) * unit
    like = lambda place: data[place : place + 2] == data[at : at + 2] and place + 4 <= end and data[place + 2] & 0xFC == data[at + 2] & 0xFC
    if known and (at + known + padding(at) == end or like(at + known + padding(at))):
        return _sized(h, known, padding(at))
    place = at
    while 0 <= (place := data.find(data[at : at + 2], place + 1, min(end, at + FREE_MOST))):
        size = place - at - padding(at)
        if like(place) and size > 8 and ((nxt := place + size + padding(place)) == end or like(nxt)):
            return _sized(h, size, padding(at))
    return None


def _sized(h: Header, size: int, padding: int) -> Header:
    return replace(h, size=size + padding, kbps=size * 8 * h.rate // h.samples // 1000)


def _chained(data: bytes, at: int, h: Header, end: int) -> bool:
    """Whether the header's size leads to the end or to a header that agrees in version, layer and rate."""
    nxt = _loose(data[at + h.size : at + h.size + 4])
    return at + h.size == end or nxt is not None and (nxt.version, nxt.layer, nxt.rate) == (h.version, h.layer, h.rate)


def _inside(data: bytes, at: int, h: Header, end: int) -> bool:
    """Whether a chain of headers starts within the frame, which then is none."""
    place = at
    while 0 <= (place := data.find(b"\xff", place + 1, at + h.size)):
        other = header(data[place : place + 4])
        if other is not None and place + other.size <= end and (other.version, other.layer, other.rate) == (h.version, h.layer, h.rate) and _chained(data, place, other, end):
            return True
    return False


def parse(data: bytes) -> Parsed:
    """Tags, frames, exact duration and checksums. A header whose size leads to the next one is a frame; so is
    the last one before a break in a chain, unless a new chain starts inside it. Elsewhere the search goes on."""
    out = Parsed()
    at, end = _tag2(data, out.tags), _tag1(data, out.tags)
    in_step, known = False, 0
    while at + 4 <= end:
        h = _loose(data[at : at + 4])
        if h is not None and not h.size and (h := _free(data, at, end, known)) is not None:
            known = h.size - (data[at + 2] >> 1 & 1) * (4 if h.layer == 1 else 1)
        if h is not None and at + h.size <= end:
            chained = _chained(data, at, h, end)
            if chained or in_step and not _inside(data, at, h, end):
                in_step = True
                if out.first is None and out.table is None and (table := _bitrate_table(data, at, h)) is not None:
                    (out.table, out.points), out.first = table, h
                else:
                    out.first = out.first or h
                    out.frames.append(at)
                    out.samples += h.samples
                    out.rate = h.rate
                    out.rates.add(h.kbps)
                    ok = verify(data, at, h)
                    out.good += ok is True
                    out.bad += ok is False
                at += h.size
                continue
        in_step = False
        nxt_at = data.find(b"\xff", at + 1, end)
        nxt_at = end if nxt_at < 0 else nxt_at
        out.skipped += nxt_at - at
        at = nxt_at
    out.microseconds = out.samples * 1_000_000 // out.rate if out.rate else 0
    return out


# Layer I, protected, 256 kbit/s, 48 kHz, mono: 256 bytes a frame. Subbands 0 to 15 take 8 bits a sample.
HEAD = bytes([0xFF, 0xFE, 0x84, 0xC0])
ALLOCATION = bytes([0x77] * 8 + [0] * 8)
SCALES = bytes(12)
START = HEAD + crc16(HEAD[2:] + ALLOCATION).to_bytes(2, "big") + ALLOCATION + SCALES
FRAME = header(HEAD).size
SAMPLES_AT = len(START)


def _frame2(name: bytes, text: bytes) -> bytes:
    n = len(text) + 1
    return name + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + b"\0\0\3" + text


def store(text: bytes) -> bytes:
    """The text, padded with spaces to a positive multiple of UNIT, as an MPEG audio stream."""
    n = len(text)
    units = max(1, -(-n // UNIT))
    samples = np.frombuffer(text.ljust(units * UNIT, b" "), np.uint8).reshape(units, UNIT)
    frames = np.zeros((units, FRAME), np.uint8)
    frames[:, :SAMPLES_AT] = np.frombuffer(START, np.uint8)
    frames[:, SAMPLES_AT : SAMPLES_AT + UNIT] = samples
    size = _frame2(b"TXXX", b"bytes\0" + str(n).encode())
    tag = b"ID3\4\0\0" + bytes([len(size) >> 21 & 127, len(size) >> 14 & 127, len(size) >> 7 & 127, len(size) & 127]) + size
    # a silent frame (no subband has bits) with the table behind its allocation
    silent = HEAD + crc16(HEAD[2:] + bytes(16)).to_bytes(2, "big") + bytes(16)
    table = b"Info" + struct.pack(">III", 3, units & 0xFFFFFFFF, ((units + 1) * FRAME) & 0xFFFFFFFF)
    return tag + (silent + table).ljust(FRAME, b"\0") + frames.tobytes()


def read(data: bytes, parsed: Parsed | None = None) -> bytes:
    """The padded payload of a stream made by store, from its parsed frames."""
    p = parsed or parse(data)
    at = np.array(p.frames, np.int64)
    raw = np.frombuffer(data, np.uint8)
    return raw[at[:, None] + np.arange(SAMPLES_AT, SAMPLES_AT + UNIT)].tobytes() if len(at) else b""


def unpadded(payload: bytes, parsed: Parsed) -> bytes:
    return payload[: int(parsed.tags.get("TXXX:bytes", len(payload)))]


def feature(data: bytes, p: Parsed) -> str:
    """Format, frames, duration, what the table says, checksums and bytes out of step, in a line."""
    h = p.first
    kind = f"mpeg{h.version:g}-layer{h.layer}" if h else "none"
    table = ",".join(f"{k}:{v}" for k, v in sorted((p.table or {}).items()))
    return f"{kind} rate={p.rate} kbps={'/'.join(map(str, sorted(p.rates)))} frames={len(p.frames)} us={p.microseconds} table={table} crc={p.good}/{p.bad} skipped={p.skipped}"


MEDIA = StructType([
    StructField("duration_us", LongType()), StructField("samples", LongType()), StructField("rate", LongType()), StructField("n_frames", LongType()),
    StructField("crc_good", LongType()), StructField("crc_bad", LongType()), StructField("skipped", LongType()),
    StructField("seek_offsets", ArrayType(LongType())), StructField("seek_points", ArrayType(LongType())), StructField("tags", StringType()), StructField("feature", StringType()),
])


@F.pandas_udf(MEDIA)
def _media(column: pd.Series) -> pd.DataFrame:
    rows = []
    for data in column:
        data = data or b""
        p = parse(data)
        tags = ";".join(f"{k}={v}" for k, v in sorted(p.tags.items()))
        rows.append((p.microseconds, p.samples, p.rate, len(p.frames), p.good, p.bad, p.skipped, p.frames, p.points, tags, feature(data, p)))
    return pd.DataFrame(rows, columns=MEDIA.names)


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """df with the fields of MEDIA read from a binary column: exact duration, seek offset of each frame and so on.

    Null and empty streams, and bytes without frames, have no frames and duration 0. Columns of those names are
    replaced. Rows are independent, so repeats, ties and empty tables need no care.
    """
    prepare(df.sparkSession)
    return df.withColumn("__media", _media(media)).withColumns({c: F.col(f"__media.{c}") for c in MEDIA.names}).drop("__media")


@F.pandas_udf(BinaryType())
def _store(texts: pd.Series) -> pd.Series:
    return pd.Series([store(t) for t in texts], dtype=object)


def store_text(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with the text as an MPEG audio stream in the column media; a null text is empty."""
    prepare(df.sparkSession)
    return df.withColumn(media, _store(utf8(text)))


DIGEST = StructType([
    StructField("n_bytes", LongType()), StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()),
    StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("duration_us", LongType()), StructField("feature", StringType()),
    StructField("seek_offsets", ArrayType(LongType())),
])


@F.pandas_udf(DIGEST)
def _digest(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        data = store(t)
        p = parse(data)
        payload = read(data, p)
        rows.append((len(unpadded(payload, p)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), p.microseconds, feature(data, p), p.frames))
    return pd.DataFrame(rows, columns=DIGEST.names)


def stored_digest(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the fields of DIGEST: each text stored, read back from the stored bytes alone, and measured.

    A null or empty text is one unit of spaces. Columns of those names are replaced; rows are independent.
    """
    prepare(df.sparkSession)
    return df.withColumn("__media", _digest(utf8(text))).withColumns({c: F.col(f"__media.{c}") for c in DIGEST.names}).drop("__media")
