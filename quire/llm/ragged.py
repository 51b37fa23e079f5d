"""Numpy over many texts at once: their bytes lie end to end, with offsets."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given spans, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), U64(base))
    out[0] = 1
    return np.cumprod(out, dtype=U64)


class Words(NamedTuple):
    packed: np.ndarray  # the words' bytes, each followed by one space
    starts: np.ndarray  # of each word in packed
    lengths: np.ndarray
    text: np.ndarray  # of each word, the text's number
    firsts: np.ndarray  # of each text, its first word's number; one more at the end
    hashes: np.ndarray


def scan_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None, hashed: bool = True) -> Words:
    """The words of all texts: runs of bytes that aren't ASCII white space; breaks: flags where a new one begins nevertheless."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if breaks is not None:
        edge[:-1] |= breaks
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    lengths = np.flatnonzero(solid & (~after | edge[1:])) + 1 - starts
    firsts = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    flat = data[solid]
    at = np.cumsum(lengths) - lengths
    packed = np.full(len(flat) + len(starts), 32, np.uint8)
    inside = np.ones(len(packed), bool)
    inside[at + lengths + np.arange(len(starts))] = False
    packed[inside] = flat
    if not len(starts) or not hashed:
        return Words(packed, at + np.arange(len(starts)), lengths, text, firsts, np.zeros(0, U64))
    place = np.arange(len(flat)) - np.repeat(at, lengths)
    sums = np.add.reduceat((flat.astype(U64) + U64(1)) * powers(0x100000001B3, int(lengths.max()))[place], at)
    return Words(packed, at + np.arange(len(starts)), lengths, text, firsts, mixed(sums + lengths.astype(U64)))


def sequence_hashes(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each run of `counts` words from `starts` on; it depends on nothing but the words' own hashes."""
    base = 0xD1342543DE82EF95
    up = powers(base, len(hashes) + 1)
    down = powers(pow(base, -1, 1 << 64), len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * up[: len(hashes)], dtype=U64)])
    return mixed((sums[starts + counts] - sums[starts]) * down[starts] + counts.astype(U64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` values in a row; shorter than x by width - 1."""
    step, out = 1, x
    while 2 * step <= width:
        out = np.minimum(out[: len(out) - step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of(flags_new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of runs, from flags that are set where a run begins."""
    first = np.flatnonzero(flags_new)
    return first, np.diff(np.append(first, len(flags_new)))
