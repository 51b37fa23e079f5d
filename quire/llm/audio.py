"""MPEG audio columns: a writer that stores bytes in frames, and a reader of any MPEG-1/2/2.5 stream.

The writer makes a variable-bitrate Layer III stream: an ID3v2 tag, a frame with a Xing table, then protected frames
whose granules have no main data, so that all the room after the side information is ancillary data, which decoders
skip; the payload lies there. The unit of storage is the frame: the last one takes the smallest bitrate that holds the
rest, and the tag tells where the payload ends.

The reader parses ID3v2 and ID3v1 tags, finds frames by their headers (a header counts if it is like that of the
frame before it or of the one after it, or the stream ends there; else it looks on from the next byte), checks the checksums of
all layers, reads Xing/Info and VBRI tables whole (frames, bytes, places to seek to) and holds them against the frames that it found,
reads the encoder's delay and padding, and gives the exact duration as samples and sample rate, with the byte offset of every frame.

Edge cases: a null or empty text is stored as 64 zero bytes. A null or damaged stream reads as what can be found in it;
without a frame there are 0 samples. Very long texts have more frames. Null and repeated identifiers pass as they are;
an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import over_texts, small_batches

UNIT = 64
BATCH_BYTES = 8 << 20

#: Kilobits a second by (MPEG-1?, layer), sample rates by version bits.
BITRATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


class Header(NamedTuple):
    version: int  # its two bits: 3 is MPEG-1, 2 MPEG-2, 0 MPEG-2.5
    layer: int
    protected: bool
    kbits: int
    rate: int
    size: int
    mono: bool
    samples: int
    side: int  # bytes of side information, Layer III


@lru_cache(4096)
def header(raw: bytes) -> Header | None:
    """The frame header in 4 bytes, if they are one. Free bitrate is none: such a frame's size isn't told."""
    word = int.from_bytes(raw, "big")
    version, layer, index, rate = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if len(raw) < 4 or word >> 21 != 0x7FF or version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    first, mono, padding = version == 3, word >> 6 & 3 == 3, word >> 9 & 1
    kbits, hertz = BITRATES[first, layer][index], RATES[version][rate]
    samples = 384 if layer == 1 else 576 if layer == 3 and not first else 1152
    size = (12_000 * kbits // hertz + padding) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hertz + padding
    return Header(version, layer, not word >> 16 & 1, kbits, hertz, size, mono, samples, (17 if mono else 32) if first else (9 if mono else 17))


CRC_TABLE = []
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1 ^ (0x8005 if _c & 0x8000 else 0)) & 0xFFFF
    CRC_TABLE.append(_c)


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The checksum over a header's last two bytes and the side information."""
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFF00) ^ CRC_TABLE[crc >> 8 ^ byte]
    return crc


#: Fixed values of Layer II: bits of the allocation of subbands 0, 1, ...: of MPEG-1's four tables, and of MPEG-2's.
ALLOCATION = {
    "a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "low": [4] * 4 + [3] * 7 + [2] * 19,
}


def allocation_of(h: Header) -> list[int]:
    each = h.kbits // (1 if h.mono else 2)
    if h.layer == 1:
        return [4] * 32
    if h.version != 3:
        return ALLOCATION["low"]
    if 56 <= each and (h.rate == 48000 or each <= 80):
        return ALLOCATION["a"]
    if each >= 96:
        return ALLOCATION["b"]
    return ALLOCATION["c" if h.rate != 32000 and each <= 48 else "d"]


def guarded_bits(frame: bytes, h: Header) -> int:
    """The bits after the checksum that it guards: the side information, or the allocation with Layer II's scale factor selectors."""
    if h.layer == 3:
        return 8 * h.side
    widths, channels = allocation_of(h), 1 if h.mono else 2
    mode, extension = frame[3] >> 6, frame[3] >> 4 & 3
    joint = min(len(widths), 4 * (extension + 1)) if mode == 1 else len(widths)
    value, total = int.from_bytes(frame[6:], "big"), 8 * (len(frame) - 6)
    place = selectors = 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < joint else 1):
            place += width
            if h.layer == 2 and total >= place and value >> (total - place) & ((1 << width) - 1):
                selectors += channels if band >= joint else 1
    return place + 2 * selectors


def checksum(frame: bytes, h: Header) -> int:
    """The checksum that a protected frame should have."""
    if h.layer == 3:
        return crc16(frame[2:4] + frame[6 : 6 + h.side])
    n = guarded_bits(frame, h)
    head = frame[6 : 6 + (n + 7) // 8]
    crc = 0xFFFF
    for byte in frame[2:4] + head[: n // 8]:
        crc = (crc << 8 & 0xFF00) ^ CRC_TABLE[crc >> 8 ^ byte]
    rest = n % 8
    if rest and len(head) > n // 8:
        for i in range(7, 7 - rest, -1):
            crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ head[n // 8] >> i) & 1 else 0)) & 0xFFFF
    return crc


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def from_synchsafe(raw: bytes) -> int:
    return sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True))


HERTZ_INDEX = 2  # of 32000 Hz, at which every bitrate gives frames of whole bytes
MONO = 3 << 6
SIDE = bytes(17)


@lru_cache(64)
def frame_head(index: int, protected: bool) -> bytes:
    raw = bytes([0xFF, 0xFA if protected else 0xFB, index << 4 | HERTZ_INDEX << 2, MONO])
    return raw + struct.pack(">H", crc16(raw[2:] + SIDE)) + SIDE if protected else raw + SIDE


#: (room, bitrate index) of protected frames
ROOMS = [(header(frame_head(i, True)[:4]).size - len(frame_head(i, True)), i) for i in range(1, 15)]


def write_stream(payload: bytes) -> bytes:
    """An MPEG audio stream that holds payload."""
    room, widest = ROOMS[-1]
    head = frame_head(widest, True)
    whole = len(payload) // room
    frames = [head + payload[i * room : (i + 1) * room] for i in range(whole)]
    rest = payload[whole * room :]
    if rest:
        space, index = next(x for x in ROOMS if x[0] >= len(rest))
        frames.append(frame_head(index, True) + rest + bytes(space - len(rest)))
    table = bytearray(frame_head(5, False))  # 64 kbit/s has room for the table
    size = header(bytes(table[:4])).size
    ends = [size]
    for f in frames:
        ends.append(ends[-1] + len(f))
    seek = bytes(min(255, 256 * ends[i * len(frames) // 100] // ends[-1]) for i in range(100))
    table += b"Xing" + struct.pack(">III", 7, len(frames), ends[-1]) + seek
    table += bytes(size - len(table))
    text = f"payload_bytes\0{len(payload)}".encode()
    field = b"TXXX" + struct.pack(">IH", len(text) + 1, 0) + b"\0" + text
    return b"".join([b"ID3\x03\x00\x00", synchsafe(len(field)), field, bytes(table), *frames])


class Table(NamedTuple):
    """A variable-bitrate table; -1 and None for what it lacks."""

    name: str  # Xing, Info, VBRI or none
    start: int  # of the frame that it is in
    frames: int = -1
    size: int = -1  # bytes, of that frame and all after it
    quality: int = -1
    places: list[int] | None = None  # Xing: 256ths of the bytes at each 100th of the duration; VBRI: bytes from one entry to the next
    step: int = 0  # VBRI: frames of an entry


NO_TABLE = Table("none", 0)


def xing_table(data: bytes, start: int, at: int) -> tuple[Table, int]:
    """(the table, where it ends)"""
    flags, place, found = int.from_bytes(data[at + 4 : at + 8], "big"), at + 8, {}
    for bit, name in ((1, "frames"), (2, "size")):
        if flags & bit:
            found[name], place = int.from_bytes(data[place : place + 4], "big"), place + 4
    if flags & 4:
        found["places"], place = list(data[place : place + 100]), place + 100
    if flags & 8:
        found["quality"], place = int.from_bytes(data[place : place + 4], "big"), place + 4
    return Table(data[at : at + 4].decode(), start, **found), place


def vbri_table(data: bytes, start: int) -> Table:
    at = start + 36
    quality, size, frames, entries, scale, width, step = (int.from_bytes(data[at + a : at + b], "big") for a, b in ((8, 10), (10, 14), (14, 18), (18, 20), (20, 22), (22, 24), (24, 26)))
    raw = data[at + 26 : at + 26 + entries * width]
    return Table("VBRI", start, frames, size, quality, [scale * int.from_bytes(raw[i * width : (i + 1) * width], "big") for i in range(entries)] if width else [], step)


def judged(table: Table, offsets: list[int], end: int) -> dict[str, bool | None]:
    """Whether a table's frames, bytes and places agree with the frames found; None for what it lacks. A place may be one unit off."""
    out: dict[str, bool | None] = {"frames": None, "bytes": None, "places": None}
    if table.name == "none" or not offsets:
        return out
    if table.frames >= 0:
        out["frames"] = table.frames == len(offsets)
    if table.size >= 0:
        out["bytes"] = table.size == end - table.start
    if table.places and table.name == "VBRI":
        ends, at = [*offsets, end], 0
        out["places"] = table.step > 0
        for i, size in enumerate(table.places):
            at += size
            out["places"] &= abs(offsets[0] + at - ends[min((i + 1) * table.step, len(offsets))]) <= max(table.places) // 100 + 4 * (i + 1)
    elif table.places and table.size > 0:
        out["places"] = len(table.places) == 100 and all(abs(p - min(255, 256 * (offsets[i * len(offsets) // 100] - table.start) // table.size)) <= 1 for i, p in enumerate(table.places))
    return out


class Stream(NamedTuple):
    tags: dict[str, str]
    offsets: list[int]  # of the audio frames
    headers: list[Header]
    checked: int
    damaged: int  # frames whose checksum is wrong
    skipped: int  # bytes passed over to find a frame
    samples: int
    rate: int
    table: Table
    agrees: dict[str, bool | None]  # as `judged` tells


def kind(h: Header) -> tuple:
    """What the frames of a stream have in common."""
    return h.version, h.layer, h.rate, h.protected


def id3v2(data: bytes, start: int) -> tuple[int, dict[str, str]]:
    """(where the tag ends, its text fields), for versions 2.3 and 2.4; unsynchronised ones are read as they were before that."""
    if data[start : start + 3] != b"ID3" or len(data) < start + 10:
        return start, {}
    major, flags = data[start + 3], data[start + 5]
    end = start + 10 + from_synchsafe(data[start + 6 : start + 10])
    inner, tags, place = data[start + 10 : end], {}, 0
    if flags & 0x80 and major < 4:
        inner = inner.replace(b"\xff\0", b"\xff")
    if flags & 0x40:
        n = inner[:4]
        place += from_synchsafe(n) if major == 4 else 4 + int.from_bytes(n, "big")
    while place + 10 <= len(inner) and inner[place]:
        name, raw, form = inner[place : place + 4].decode("latin-1"), inner[place + 4 : place + 8], inner[place + 9]
        n = from_synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        body = inner[place + 10 : place + 10 + n]
        if major == 4:
            body = body[4:] if form & 1 else body
            body = body.replace(b"\xff\0", b"\xff") if form & 2 else body
        if name[:1] == "T" and body:
            text = body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\0")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            tags[name] = text
        place += 10 + n
    return end + 10 * (major == 4 and bool(flags & 0x10)), tags


def read_stream(data: bytes | None) -> Stream:
    data = data or b""
    place, tags = id3v2(data, 0)
    end = len(data)
    if end - place >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            tags.setdefault(name, data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip())
    offsets, headers, checked, damaged, skipped, locked, last = [], [], 0, 0, 0, False, None
    table, trim, last_end = NO_TABLE, 0, 0
    while place + 4 <= end:
        h = header(data[place : place + 4])
        following = place + h.size if h else 0
        fits = h is not None and following <= end
        if fits and not (locked and kind(h) == last) and following + 4 <= end:  # unlike the frame before it, so it must be like the one after it
            then = header(data[following : following + 4])
            fits = then is not None and kind(then)[: 3 + locked] == kind(h)[: 3 + locked]
        if not fits:
            skipped += 1
            locked = False
            place += 1
            continue
        locked, last = True, kind(h)
        last_end = following
        if not offsets and table.name == "none" and h.layer == 3:
            at = place + 4 + 2 * h.protected + h.side
            if data[at : at + 4] in (b"Xing", b"Info"):
                table, more = xing_table(data, place, at)
                if more + 24 <= following and data[more : more + 4] in (b"LAME", b"Lavc", b"Lavf"):
                    gap = int.from_bytes(data[more + 21 : more + 24], "big")
                    trim = (gap >> 12) + (gap & 0xFFF)
                place = following
                continue
            if data[place + 36 : place + 40] == b"VBRI":
                table = vbri_table(data, place)
                place = following
                continue
        if h.protected:
            checked += 1
            damaged += checksum(data[place:following], h) != int.from_bytes(data[place + 4 : place + 6], "big")
        offsets.append(place)
        headers.append(h)
        place = following
    skipped += max(0, end - place) if not locked or place < end else 0
    return Stream(tags, offsets, headers, checked, damaged, skipped, max(0, sum(h.samples for h in headers) - trim), headers[0].rate if headers else 0, table, judged(table, offsets, last_end))


def told(s: Stream) -> str:
    """The table and what of it agrees with the frames."""
    return " ".join([s.table.name, *(f"{k} {'right' if v else 'wrong'}" for k, v in s.agrees.items() if v is not None)])


def payload_of(data: bytes, stream: Stream) -> bytes:
    """What `write_stream` stored."""
    parts = [data[o + 4 + 2 * h.protected + h.side : o + h.size] for o, h in zip(stream.offsets, stream.headers, strict=True)]
    return b"".join(parts)[: int(stream.tags.get("payload_bytes", 0))]


def store(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, with zeros up to a positive multiple of 64, as an MPEG stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            sizes, media = [], []
            for x in batch.column("text").to_pylist():
                raw = (x or "").encode()
                sizes.append(len(raw))
                media.append(write_stream(raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return over_texts(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id)


PROBED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, sample_rate int, seek_offsets array<long>"


def probe(media: DataFrame, *, column: str = "media") -> DataFrame:
    """The other columns of media, then what its streams hold: payload digests, exact duration and frame offsets."""
    others = [c for c in media.columns if c != column]
    names = [x.split()[0] for x in PROBED.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column, BATCH_BYTES):
            rows = []
            for data in batch.column(column).to_pylist():
                data = data or b""
                s = read_stream(data)
                payload = payload_of(data, s)
                kinds = "+".join(f"MPEG-{ {3: '1', 2: '2', 0: '2.5'}[v] } layer {n}" for v, n in sorted({(h.version, h.layer) for h in s.headers}, reverse=True)) or "none"
                kbits = sorted({h.kbits for h in s.headers})
                feature = f"{kinds}; {s.samples}/{s.rate or 1} s; frames {len(s.offsets)}; kbit/s {kbits[0] if kbits else 0}-{kbits[-1] if kbits else 0}; table {told(s)}; checksums {s.checked - s.damaged} of {s.checked}; skipped {s.skipped}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, s.samples, s.rate, s.offsets))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            columns = [batch.column(c) for c in others] + [pa.array(list(x), t) for x, t in zip(list(zip(*rows, strict=True)) or [()] * 9, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, others + names)

    schema = ", ".join([f"`{c}` {media.schema[c].dataType.simpleString()}" for c in others] + [PROBED])
    return over_texts(media, work, schema)
