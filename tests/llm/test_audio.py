import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm.audio import crc16, header, payload_of, probe, read_stream, store, write_stream


def padded(text):
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def check(df):
    got = probe(store(df)).collect()
    want = []
    for r in df.collect():
        p = padded(r.text)
        want.append((r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.samples == 1152 * len(r.seek_offsets) and r.sample_rate == 32000 for r in got)


def test_documents(docs, odd, none):
    check(docs)
    check(odd.withColumns({"id": F.lit("x"), "media": F.lit(1), "feature": F.lit(None).cast("int")}))
    assert probe(store(none)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 64, 1416, 1417, 1418, 5000, 100_000])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = write_stream(payload)
    s = read_stream(data)
    assert payload_of(data, s) == payload and s.damaged == s.skipped == 0 and s.checked == len(s.offsets)
    assert s.table.name == ("Xing" if n else "none") or n == 0
    assert not n or s.table.frames == len(s.offsets) and s.agrees == {"frames": True, "bytes": True, "places": True}


def test_payload_like_headers_and_tags():
    payload = (b"\xff\xfa\xe8\xc0" * 700 + b"TAGID3Xing") * 3
    data = write_stream(payload)
    assert payload_of(data, read_stream(data)) == payload


def test_resynchronises_and_counts_damage():
    payload = random.Random(1).randbytes(20_000)
    data = write_stream(payload)
    s = read_stream(data)
    broken = bytearray(data)
    broken[s.offsets[3] + 8] ^= 1  # side information
    assert read_stream(bytes(broken)).damaged == 1
    junk = data[: s.offsets[5]] + b"\xff\xfbjunk\xff" * 9 + data[s.offsets[5] :]
    t = read_stream(junk)
    assert len(t.offsets) == len(s.offsets) and t.skipped == 63 and t.offsets[5] == s.offsets[5] + 63
    cut = read_stream(data[:-100])
    assert len(cut.offsets) == len(s.offsets) - 1 and cut.skipped > 0
    assert read_stream(None).samples == 0 and read_stream(b"abc").offsets == []


def test_headers():
    h = header(bytes([0xFF, 0xFB, 0x90, 0x00]))
    assert (h.kbits, h.rate, h.size, h.samples, h.side) == (128, 44100, 417, 1152, 32)
    assert header(bytes([0xFF, 0xFB, 0xF0, 0x00])) is None and header(b"\xff\xfb\x00\x00") is None
    h = header(bytes([0xFF, 0xF3, 0x80, 0xC0]))  # MPEG-2 layer III mono
    assert (h.rate, h.samples, h.side, h.kbits, h.size) == (22050, 576, 9, 64, 208)

    def bitwise(data):
        crc = 0xFFFF
        for byte in data:
            for i in range(7, -1, -1):
                crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ byte >> i) & 1 else 0)) & 0xFFFF
        return crc

    for n in (0, 1, 19, 34):
        data = random.Random(n).randbytes(n)
        assert crc16(data) == bitwise(data)


def test_tags_and_tables():
    frame = bytes([0xFF, 0xFB, 0x90, 0xC0])
    size = header(frame).size
    lame = bytearray(frame + bytes(17) + b"Info" + (1).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"LAME3.100" + bytes(12) + ((576 << 12) | 1000).to_bytes(3, "big"))
    lame += bytes(size - len(lame))
    audio = (frame + bytes(size - 4)) * 3
    tag = b"TAG" + b"Song".ljust(30, b"\0") + b"Singer".ljust(30, b"\0") + bytes(65)
    s = read_stream(bytes(lame) + audio + tag)
    assert (s.table.name, s.table.frames, s.samples, s.tags["TIT2"], s.tags["TPE1"]) == ("Info", 3, 3 * 1152 - 1576, "Song", "Singer")
    assert s.agrees == {"frames": True, "bytes": None, "places": None} and read_stream(bytes(lame) + audio[:size]).agrees["frames"] is False
    vbri = bytearray(frame + bytes(size - 4))
    body = b"VBRI" + bytes(4) + (78).to_bytes(2, "big") + (size * 5).to_bytes(4, "big") + (4).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (2, 1, 2, 2)) + (2 * size).to_bytes(2, "big") * 2
    vbri[36 : 36 + len(body)] = body
    t = read_stream(bytes(vbri) + audio + audio[:size])
    assert (t.table.name, t.table.frames, t.table.quality, t.table.places, len(t.offsets)) == ("VBRI", 4, 78, [2 * size, 2 * size], 4)
    assert t.agrees == {"frames": True, "bytes": True, "places": True}
    vbri[36 + 26 : 36 + 28] = size.to_bytes(2, "big")
    assert read_stream(bytes(vbri) + audio).agrees == {"frames": False, "bytes": False, "places": False}


def test_wrong_seek_table():
    data = bytearray(write_stream(random.Random(3).randbytes(200_000)))
    at = data.index(b"Xing") + 16
    assert read_stream(bytes(data)).agrees["places"] and read_stream(bytes(data)).table.places == list(data[at : at + 100])
    data[at + 50] = 3
    assert read_stream(bytes(data)).agrees == {"frames": True, "bytes": True, "places": False}


def bits_crc(bits):
    crc = 0xFFFF
    for b in bits:
        top = crc >> 15
        crc = crc << 1 & 0xFFFF
        if top != int(b):
            crc ^= 0x8005
    return crc


#: (second and following header bytes, widths of the subbands' allocations, channels)
OTHER_LAYERS = [
    (bytes([0xFE, 0xC4, 0x00]), [4] * 32, 2, 32),  # layer I, 384 kbit/s, 48 kHz, stereo
    (bytes([0xFE, 0x84, 0xC0]), [4] * 32, 1, 32),
    (bytes([0xFC, 0xA0, 0x00]), [4] * 11 + [3] * 12 + [2] * 7, 2, 30),  # layer II, 192 kbit/s, 44.1 kHz
    (bytes([0xFC, 0xA0, 0x50]), [4] * 11 + [3] * 12 + [2] * 7, 2, 8),  # joint stereo from subband 8 on
    (bytes([0xFC, 0x44, 0xC0]), [4] * 11 + [3] * 12 + [2] * 4, 1, 27),  # 64 kbit/s, 48 kHz, mono
    (bytes([0xFC, 0x20, 0xC0]), [4] * 2 + [3] * 6, 1, 8),  # 48 kbit/s, 44.1 kHz, mono
    (bytes([0xFC, 0x28, 0xC0]), [4] * 2 + [3] * 10, 1, 12),  # at 32 kHz
    (bytes([0xF4, 0x84, 0x00]), [4] * 4 + [3] * 7 + [2] * 19, 2, 30),  # MPEG-2
]


@pytest.mark.parametrize("tail,widths,channels,joint", OTHER_LAYERS)
def test_checksums_of_other_layers(tail, widths, channels, joint):
    rng = random.Random(len(widths) * channels + joint)
    head = b"\xff" + tail
    h = header(head)
    frames = []
    for _ in range(4):
        allocation, selectors = "", ""
        for band, width in enumerate(widths):
            for _ in range(channels if band < joint else 1):
                value = rng.choice([0, rng.randrange(1, 1 << width)])
                allocation += f"{value:0{width}b}"
                if value and h.layer == 2:
                    selectors += "".join(rng.choice("01") for _ in range(2 * (channels if band >= joint else 1)))
        guarded = allocation + selectors
        crc = bits_crc("".join(f"{b:08b}" for b in head[2:]) + guarded)
        body = guarded + "".join(rng.choice("01") for _ in range(8 * (h.size - 6) - len(guarded)))
        frames.append(head + crc.to_bytes(2, "big") + int(body, 2).to_bytes(h.size - 6, "big"))
    s = read_stream(b"".join(frames))
    assert (len(s.offsets), s.checked, s.damaged) == (4, 4, 0)
    broken = bytearray(b"".join(frames))
    broken[h.size + 6] ^= 0x80
    assert read_stream(bytes(broken)).damaged == 1


def test_unsynchronised_tags():
    def field(name, body, raw=4):
        size = len(body).to_bytes(4, "big") if raw == 3 else bytes(len(body) >> n & 127 for n in (21, 14, 7, 0))
        return name, size, body

    text = b"\x01\xff\xfeA\0\xff\0"  # UTF-16 with a byte order mark
    name, size, body = field(b"TIT2", text, 3)
    inner = (name + size + b"\0\0" + body).replace(b"\xff", b"\xff\0")
    old = b"ID3\x03\0\x80" + bytes(len(inner) >> n & 127 for n in (21, 14, 7, 0)) + inner
    assert read_stream(old).tags["TIT2"] == "Aÿ"
    body = text.replace(b"\xff", b"\xff\0")
    name, size, body = field(b"TIT2", bytes([0, 0, 0, len(text)]) + body)
    new = b"ID3\x04\0\0" + bytes([0, 0, 0, len(body) + 10]) + name + size + b"\0\x03" + body
    assert read_stream(new).tags["TIT2"] == "Aÿ"
