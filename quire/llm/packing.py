"""Packing token sequences by order-preserving dynamic programming.

The documents of a partition, in its order, are one stream of token ids. Sequences are cut from it at the ends of
documents or sentences (and on a coarse grid where a stretch has neither), so that the padding plus the penalties
for cutting into a document are least. With f(p) the least cost up to a cut at p,

    f(p) = penalty(p) + min over q in [p - size, p) of f(q) + padding(p - q)

and as padding is size - (p - q), the minimum is a sliding one of f(q) + q: a monotone queue gives it at constant
cost a cut. A sequence whose length is a power of two is not padded, which adds a few transitions from fixed
distances. The stream is solved in batches; what follows a batch's last cut stays open for the next batch, so that
memory is bounded by a batch and a sequence. Nothing is shuffled: the sequences of a partition are its own, and
a retried task makes the same ones. A partition wastes less than one sequence at its end.

Token ids: a text's ids are those of its words (parts between ASCII white space) in turn, since white space never
is part of a token here; so each distinct word is encoded once a task, as far as a bounded cache holds them. A worker keeps few
of them from task to task, so that what runs in it next has the memory.

Edge cases: a null text is empty and has the end token only. Null and repeated identifiers pass as they are. A very
long document spans many sequences. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import over_texts, small_batches
from quire.llm.ragged import scan_words, spans, text_bytes

SIZE = 2048
END = 1
SENTENCE_PENALTY = 8
INNER_PENALTY = 64
#: Where neither documents nor sentences end, cuts are tried after so many tokens.
GRID = 256
#: The shortest sequence that a power of two ends early, and what a sequence more is held to cost.
LEAST_EVEN = 512
EVEN_PENALTY = 8
CACHE_WORDS = 600_000
#: Words that a worker keeps after a task.
KEPT_WORDS = 50_000
BATCH_BYTES = 2 << 20


#: How a tokenizer's file describes text handling that makes words, and letters and stops, independent.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
#: Lower-case letters up to U+00FF, and the space that ends a key.
PLAIN_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+ ").fullmatch
#: Byte-level vocabularies write printable Latin-1 bytes as they are, the others as U+0100 and following in order.
BYTE_SIGNS = dict(zip([b for b in range(256) if b < 33 or 126 < b < 161 or b == 173], range(256, 400), strict=False))


class WordIds:
    """Token ids of words, each encoded once while the cache lasts. Place 0 holds the end token. A word's key ends in a space."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end = end
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.by_word = told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == PRE_TOKENIZER
        self.clear()

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words; those of plain lower-case letters are one unit of the model's, which needn't be looked for."""
        plain = [PLAIN_WORD(w) is not None for w in words]
        rest = iter(self.encode_texts([w[:-1].decode() for w, p in zip(words, plain, strict=True) if not p]))
        return [[t.id for t in self.model.tokenize(w[:-1].decode("latin-1").translate(BYTE_SIGNS))] if p else next(rest) for w, p in zip(words, plain, strict=True)]

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat = [np.array([self.end], np.uint32)]
        self.starts, self.counts, self.total = [np.zeros(1, np.int64)], [np.ones(1, np.int64)], 1

    def shrink(self, most: int) -> None:
        """Forgets all but the first words, which are frequent ones mostly."""
        if len(self.place) > most:
            self.place = dict(islice(self.place.items(), most))
            self.starts, self.counts = ([x[0][: most + 1].copy()] for x in (self.starts, self.counts))
            self.total = int(self.starts[0][-1] + self.counts[0][-1])
            self.flat = [self.flat[0][: self.total].copy()]

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the cache, start and count of each word)"""
        if len(self.place) > CACHE_WORDS:
            self.clear()
        at = list(map(self.place.get, words))
        new = [w for w, i in zip(words, at, strict=True) if i is None]
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            ids = self.encode(part)
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())))
            self.starts.append(self.total + np.cumsum(counts) - counts)
            self.counts.append(counts)
            self.total += int(counts.sum())
            self.place.update(zip(part, range(len(self.place) + 1, len(self.place) + 1 + len(part)), strict=True))
        if new:
            self.flat, self.starts, self.counts = ([np.concatenate(x)] for x in (self.flat, self.starts, self.counts))
            at = list(map(self.place.__getitem__, words))
        at = np.array(at, np.int64)
        return self.flat[0], self.starts[0][at], self.counts[0][at]


@lru_cache(2)
def word_ids(path: str, end: int) -> WordIds:
    """A worker's cache, of which `KEPT_WORDS` outlast a task."""
    return WordIds(path, end)


def flags(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


STOP_BYTES = flags(b".,;:!?")
PLAIN = flags(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
NO_LETTERS = flags(bytes([0x97, 0xB7]))  # in U+00C0 to U+00FF, all others of which are letters


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(data with A-Z lower-cased, flags between a letter or digit and a stop): fewer distinct words, with the same ids.

    The tokenizer lower-cases, and parts letters and digits from stops, in any case. A letter before a character from
    U+0300 on stays as it is: the tokenizer composes characters first, and some marks have a composed form with one
    case only. Texts with a < stay as they are: its special strings begin so, and are read in the text as it is.
    """
    n = len(data)
    free = np.ones(n, bool)
    signs = np.flatnonzero(data == ord("<"))
    if len(signs):
        texts = np.unique(np.searchsorted(offsets, signs, "right") - 1)
        free[spans(offsets[texts], offsets[texts + 1] - offsets[texts])] = False
    capital = free & (data >= 65) & (data <= 90)
    capital[:-1] &= data[1:] < 0xCC  # the first byte of U+0300; the last byte of a text has no mark after it, whatever follows
    lowered = np.where(capital, data + np.uint8(32), data)
    if n < 2:
        return lowered, np.zeros(n, bool)
    stop = STOP_BYTES[data]
    pair = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & ~NO_LETTERS[data[1:]]
    ends, begins = PLAIN[data], PLAIN[data]
    ends[1:] |= pair
    begins[:-1] |= pair
    breaks = np.zeros(n, bool)
    breaks[1:] = free[1:] & (ends[:-1] & stop[1:] | stop[:-1] & begins[1:])
    return lowered, breaks


def encode(texts: pa.Array, cache: WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts with their end tokens, tokens of each text, positions after the ends of sentences)

    A tokenizer of another kind than words are independent for gets whole texts, and no sentences are told.
    """
    if not cache.by_word:
        ids = [[*x, cache.end] for x in cache.encode_texts([x or "" for x in texts.to_pylist()])]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes, np.zeros(0, np.int64)
    data, offsets = text_bytes(texts)
    lowered, breaks = units(data, offsets)
    words = scan_words(lowered, offsets, breaks, hashed=False)
    n = len(words.starts)
    ends = np.append(words.starts, len(words.packed)).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(words.packed)]).dictionary_encode()
    flat, starts, counts = cache.of(coded.dictionary.to_pylist())
    of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    stops = SENTENCE_ENDS[words.packed[words.starts + words.lengths - 1]]
    at = words.firsts[1:]  # after each text's words comes the cache's place 0, the end token
    start, count, stop = np.insert(starts[of], at, 0), np.insert(counts[of], at, 1), np.insert(stops, at, False)
    after = np.cumsum(count)
    last = at + np.arange(len(at))
    sizes = np.diff(np.append(0, after[last]))
    return flat[spans(start, count)], sizes, after[stop]


SENTENCE_ENDS = flags(b".!?")


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) of the places to cut, from 0 on."""
    known = np.unique(np.concatenate([[0], doc_ends, sentence_ends]))
    gaps = np.diff(np.append(known, total))
    wide = np.flatnonzero(gaps > GRID)
    more = np.concatenate([np.arange(known[i] + GRID, known[i] + gaps[i], GRID) for i in wide]) if len(wide) else np.zeros(0, np.int64)
    places = np.union1d(known, more).astype(np.int64)
    penalties = np.full(len(places), INNER_PENALTY)
    penalties[np.isin(places, sentence_ends)] = SENTENCE_PENALTY
    penalties[np.isin(places, doc_ends)] = 0
    return places, penalties


def best_cuts(places: np.ndarray, penalties: np.ndarray, size: int, total: int, last: bool) -> list[int]:
    """The cuts of least cost, from 0 on. Unless it is the last batch, what follows the last cut stays open."""
    n = len(places)
    evens = []
    step = LEAST_EVEN
    while step < size:
        at = np.searchsorted(places, places - step)
        evens.append(np.where(places[np.minimum(at, n - 1)] == places - step, at, -1).tolist())
        step *= 2
    evens = list(zip(*evens, strict=True)) if evens else [()] * n
    at, penalty = places.tolist(), penalties.tolist()
    cost, back = [0] * n, [-1] * n
    queue = deque([(0, 0)])  # (f(q) + q, q's number), rising
    for i in range(1, n):
        p = at[i]
        while at[queue[0][1]] < p - size:
            queue.popleft()
        value, q = queue[0]
        value += size - p
        for j in evens[i]:
            if j >= 0 and cost[j] + EVEN_PENALTY < value:
                value, q = cost[j] + EVEN_PENALTY, j
        value += penalty[i]
        cost[i], back[i] = value, q
        value += p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, i))
    i = n - 1
    if not last:
        i = min((j for j in range(n - 1, -1, -1) if at[j] >= total - size), key=lambda j: (cost[j] + at[j], j))
    cuts = []
    while i >= 0:
        cuts.append(at[i])
        i = back[i]
    return cuts[::-1]


class Stream:
    """What of a partition isn't cut yet."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.sequence = size, first_sequence
        self.ids = np.zeros(0, np.uint32)
        self.docs: list = []  # of each document with tokens left: identifier, tokens, tokens before what is left
        self.left = np.zeros(0, np.int64)  # tokens left of each
        self.stops = np.zeros(0, np.int64)

    def add(self, docs: list, ids: np.ndarray, sizes: np.ndarray, stops: np.ndarray) -> None:
        self.stops = np.concatenate([self.stops, stops + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.left = np.concatenate([self.left, sizes])
        self.docs += [(d, n, 0) for d, n in zip(docs, sizes.tolist(), strict=True)]

    def pieces(self, last: bool) -> Iterator[tuple]:
        """(document, start, length, ids, tokens, sequence, offset)"""
        total = len(self.ids)
        if not total:
            return
        ends = np.cumsum(self.left)
        places, penalties = candidates(ends, self.stops[self.stops < total], total)
        cuts = best_cuts(places, penalties, self.size, total, last)
        doc = 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            place = a
            while place < b:
                name, tokens, before = self.docs[doc]
                begin = int(ends[doc] - self.left[doc])
                stop = min(b, int(ends[doc]))
                yield name, before + place - begin, stop - place, self.ids[place:stop], tokens, self.sequence, place - a
                doc += stop == ends[doc]
                place = stop
            self.sequence += 1
        done = cuts[-1]
        self.docs, self.left = self.docs[doc:], self.left[doc:].copy()
        if self.docs:
            name, tokens, before = self.docs[0]
            gone = done - int(ends[doc] - self.left[0])
            self.docs[0] = (name, tokens, before + gone)
            self.left[0] -= gone
        self.ids = self.ids[done:].copy()
        self.stops = self.stops[self.stops > done] - done


def pack(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]). tokenizer: path of a file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_ids(tokenizer, end)
        stream = Stream(size, TaskContext.get().partitionId() << 40)
        held = None
        for batch in small_batches(batches, "text", BATCH_BYTES):
            if held is not None:
                yield out(stream, held.schema, last=False)
            stream.add(batch.column("id").to_pylist(), *encode(batch.column("text"), cache))
            held = batch
        cache.shrink(KEPT_WORDS)
        if held is not None:
            yield out(stream, held.schema, last=True)

    def out(stream: Stream, schema: pa.Schema, last: bool) -> pa.RecordBatch:
        rows = [(d, s, n, zlib.crc32(x.astype("<u4").tobytes()), t, q, o, x) for d, s, n, x, t, q, o in stream.pieces(last)]
        columns = list(zip(*rows, strict=True)) or [()] * 8
        arrays = [pa.array(columns[0], schema.field("id").type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
        if with_ids:
            arrays.append(pa.array([x.tolist() for x in columns[7]], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, [*"id start length ids_crc32 doc_tokens sequence_id offset ids".split()][: len(arrays)])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return over_texts(rows, work, schema).withColumnRenamed("id", id)
