import hashlib
import random
import struct
import zlib

from taintloom.llm import media as M


def frame(kbps_index, protect=True, junk=b"\x11"):
    """A Layer III frame, 44.1 kHz, stereo."""
    head = bytes([0xFF, 0xFA if protect else 0xFB, kbps_index << 4, 0x00])
    h = M.header(head)
    side = bytes(range(32))
    check = M.crc16(head[2:] + side).to_bytes(2, "big") if protect else b""
    return (head + check + side).ljust(h.size, junk)


def test_headers_and_checksum():
    assert M.header(b"\xff\xfb\x90\x00").size == 417 and M.header(b"\xff\xfb\x92\x00").size == 418
    assert M.header(b"\xff\xf3\x90\x00").samples == 576
    assert M.header(b"\xff\xff\xff\xff") is None and M.header(b"\xff\xfb") is None
    assert M.crc16(b"123456789") == 0xAEE7  # the published check value of this checksum


def test_stream_with_tags_table_junk_and_a_bad_checksum():
    tags = M._frame2(b"TIT2", "Título".encode())
    tag = b"ID3\4\0\0" + bytes([0, 0, 0, len(tags)]) + tags
    first = bytearray(frame(9))
    first[36:40] = b"Xing"
    first[40:52] = struct.pack(">III", 3, 4, 9999)
    bad = bytearray(frame(5))
    bad[10] ^= 1
    parts = [frame(9), frame(11, False), bytes(bad), frame(9)]
    junk = b"\xff\xfb\x90 no frame \xff\xff"
    body = tag + bytes(first) + parts[0] + parts[1] + junk + parts[2] + parts[3]
    data = body + b"TAG" + b"Song".ljust(30, b"\0") + b"Artist".ljust(30, b"\0") + bytes(65)
    p = M.parse(data)
    at = len(tag) + len(first)
    want = [at, at + len(parts[0]), at + len(parts[0]) + len(parts[1]) + len(junk)]
    want.append(want[2] + len(parts[2]))
    assert p.frames == want
    assert p.table == {"frames": 4, "bytes": 9999}
    assert (p.good, p.bad, p.skipped) == (2, 1, len(junk))
    assert p.tags == {"TIT2": "Título", "TPE1": "Artist"}
    assert p.microseconds == 4 * 1152 * 1_000_000 // 44100


def test_damage_never_crashes():
    r = random.Random(4)
    data = M.store(b"some text " * 300)
    for _ in range(200):
        raw = bytearray(data[r.randint(0, 900) : r.randint(900, len(data))])
        for _ in range(r.randint(0, 30)):
            raw[r.randrange(len(raw))] = r.choice([0xFF, 0xFE, r.randrange(256)])
        M.feature(bytes(raw), M.parse(bytes(raw)))
    assert M.parse(b"").frames == [] and M.parse(b"\xff" * 5000).microseconds == 0


def test_round_trip(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "x" * 193, "😀 long " * 20000, "a"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, feature string").repartition(3)
    got = {r.doc_id: r for r in M.stored_digest(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        stored = M.store(raw)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert M.unpadded(M.read(stored), M.parse(stored)) == raw
        frames = len(padded) // 192
        assert r.duration_us == frames * 384 * 1_000_000 // 48000
        assert f"crc={frames}/0 skipped=0" in r.feature and f"frames:{frames}" in r.feature
    assert got[2].feature == got[7].feature
    kept = {r.doc_id: r for r in M.media_columns(M.store_text(df)).collect()}
    assert kept[4].n_frames == 1 and kept[5].n_frames == 2 and len(kept[5].seek_offsets) == 2
    assert M.media_columns(spark.createDataFrame([(None,), (bytearray(b"junk"),)], "media binary")).select("n_frames").collect() == [(0,), (0,)]
    assert M.stored_digest(df.limit(0)).collect() == []


def crc_of_bits(bits):
    """The checksum by long division of a string of bits."""
    crc = 0xFFFF
    for b in bits:
        top = crc >> 15 ^ int(b)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def layer2(head, allocations, channels, bound):
    """A protected Layer II frame with random allocations, its checksum taken over bits written one by one."""
    r = random.Random(sum(head))
    bits, used = "", []
    for k, n in enumerate([n for count, n in allocations for _ in range(count)]):
        for c in range(channels if k < bound else 1):
            value = r.choice([0, r.randrange(1 << n)])
            bits += format(value, f"0{n}b")
            used += [bool(value)] * (1 if k < bound else channels)
    bits += "".join(format(r.randrange(4), "02b") for u in used if u)
    check = crc_of_bits("".join(format(b, "08b") for b in head[2:]) + bits)
    bits += "0" * (-len(bits) % 8)
    body = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    return (head + check.to_bytes(2, "big") + body).ljust(M.header(head).size, b"\x55")


def test_layer_2_checksums():
    a = M.ALLOCATIONS
    cases = [  # version 1: kbit/s index, rate, mode; and version 2
        (bytes([0xFF, 0xFC, 0xA4, 0x00]), a["version 1, 27 subbands"], 2, 99),  # 192 kbit/s, 48 kHz
        (bytes([0xFF, 0xFC, 0xE0, 0x00]), a["version 1, 30 subbands"], 2, 99),  # 384 kbit/s, 44.1 kHz
        (bytes([0xFF, 0xFC, 0x10, 0xC0]), a["version 1, 8 subbands"], 1, 99),  # 32 kbit/s, 44.1 kHz, mono
        (bytes([0xFF, 0xFC, 0x18, 0xC0]), a["version 1, 12 subbands"], 1, 99),  # 32 kbit/s, 32 kHz, mono
        (bytes([0xFF, 0xFC, 0xE0, 0x50]), a["version 1, 30 subbands"], 2, 8),  # joint stereo
        (bytes([0xFF, 0xF4, 0x80, 0x00]), a["version 2"], 2, 99),
    ]
    for head, allocations, channels, bound in cases:
        one = layer2(head, allocations, channels, bound)
        p = M.parse(one * 3)
        assert (len(p.frames), p.good, p.bad) == (3, 3, 0), head.hex()
        broken = bytearray(one)
        broken[7] ^= 4
        assert M.parse(one + bytes(broken) + one).bad == 1


def test_seek_points():
    first = bytearray(frame(9))
    first[36:40] = b"Xing"
    first[40:52] = struct.pack(">III", 15, 4, 2560)
    first[52:152] = bytes(range(100))
    first[152:156] = struct.pack(">I", 77)
    p = M.parse(bytes(first) + frame(9) * 3)
    assert p.table == {"frames": 4, "bytes": 2560, "quality": 77} and p.points == [10 * i for i in range(100)]
    first = bytearray(frame(9))
    first[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4000, 4, 3, 2, 2, 1)
    first[62:68] = struct.pack(">HHH", 5, 6, 7)
    p = M.parse(bytes(first) + frame(9) * 3)
    assert p.table == {"bytes": 4000, "frames": 4} and p.points == [0, 10, 22, 36]


def test_free_format():
    def free(padded, size=300):
        return (bytes([0xFF, 0xFB, 0x02 if padded else 0x00, 0x00]).ljust(size + padded, b"\x11"))

    data = b"junk" + free(0) + free(1) + free(1) + free(0)
    p = M.parse(data)
    assert p.frames == [4, 304, 605, 906] and p.skipped == 4
    assert p.rates == {300 * 8 * 44100 // 1152 // 1000} and p.samples == 4 * 1152
    assert M.parse(free(0)).frames == []
