"""Periodic runs of words: stretches that repeat a block of q words, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q whose length is at least max(LEAST, 3 * q) and which no
neighbouring word extends with that period. Runs are found by internal pattern matching, for all texts of a batch at once:

* Prefix doubling ranks the words by the next 2^k of them and so gives a suffix array; at each level only what is
  still tied is sorted again. Equal ranks also answer how far two places agree, forwards and backwards.
* At level k the text is cut into dyadic blocks of 2^k words. A run of period q holds such a block, with 2^k <= q < 2^(k+1),
  and the same block again q words on (periods under 8 are found by blocks of 8, since LEAST is 24). A wavelet matrix over
  the suffix array's places answers by range successor where a block occurs in the window next to it.
* Three or more such occurrences are a progression whose step is a period of the block. Of it only those two can
  give the run's period that lie in their own stretch of that step as the block lies in its own, from the left or from the right.
* Each candidate period is stretched as far as it holds; of equal stretches the one with the smallest period is the run.

Only blocks that occur twice in their text are asked about, so that plain prose costs little more than its suffix array.

Edge cases: a null or empty text has no words and no runs, and its collapsed text is empty. Ties for the best run go to the smaller start,
then the smaller period. A very long text is worked on whole, in a batch of its own. Repeated rows give repeated rows, an empty table an
empty result; other columns play no part, whatever their names. Null identifiers stay null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import over_texts, small_batches, words
from quire.llm.ragged import scan_words, text_bytes

LEAST = 24
BATCH_BYTES = 1 << 20


class Texts(NamedTuple):
    """The words of some texts, one text after the other."""

    ids: np.ndarray  # equal for equal words of a text, and for no others
    firsts: np.ndarray  # of each text, its first word's number; one more at the end
    ends: np.ndarray  # of each word, the end of its text


class Suffixes(NamedTuple):
    ranks: list[np.ndarray]  # of each level, of each word: how many have smaller 2^k words from there on
    sizes: list[np.ndarray]  # and how many have the same
    order: np.ndarray  # the suffix array


def number_words(column: pa.Array) -> tuple[Texts, np.ndarray, np.ndarray]:
    """(texts, bytes of the words, each followed by a space, where each word starts among them)"""
    found = scan_words(*text_bytes(column), hashed=False)
    n = len(found.starts)
    ends = np.append(found.starts, len(found.packed)).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(found.packed)]).dictionary_encode()
    of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Texts(found.text * np.int64(len(coded.dictionary)) + of, found.firsts, np.repeat(found.firsts[1:], np.diff(found.firsts))), found.packed, ends


def ranked(keys: np.ndarray, at: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the places `at` by keys; (places, ranks, sizes of their classes). base: rank of each place's old class, which keys respect."""
    order = np.argsort(keys, kind="stable")
    sorted_keys, places = keys[order], at[order]
    new = np.append(True, sorted_keys[1:] != sorted_keys[:-1]) if len(at) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    old = base[order]
    old_new = np.append(True, old[1:] != old[:-1]) if len(at) else np.zeros(0, bool)
    old_first = np.flatnonzero(old_new)[np.cumsum(old_new) - 1] if len(at) else first
    return places, old + first[group] - old_first, np.diff(np.append(first, len(at)))[group]


def suffixes(texts: Texts) -> Suffixes:
    n = len(texts.ids)
    places, rank, size = ranked(texts.ids, np.arange(n), np.zeros(n, np.int64))
    ranks, sizes = [np.empty(n, np.int64)], [np.empty(n, np.int64)]
    ranks[0][places], sizes[0][places] = rank, size
    order = places
    longest = int(np.diff(texts.firsts).max(initial=0))
    step = 1
    while step < longest:
        last, count = ranks[-1], sizes[-1]
        at = order[count[order] > 1]  # still in the order of their ranks
        if not len(at):
            break
        beyond = at + step
        inside = beyond < texts.ends[at]
        second = np.where(inside, last[np.minimum(beyond, n - 1)] + 1, 0)  # what ends sooner comes first
        places, rank, size = ranked(last[at] * np.int64(n + 1) + second, at, last[at])
        now, many = last.copy(), count.copy()
        now[places], many[places] = rank, size
        order = order.copy()
        order[count[order] > 1] = places
        ranks.append(now)
        sizes.append(many)
        step *= 2
    return Suffixes(ranks, sizes, order)


def agree_forwards(texts: Texts, found: Suffixes, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i and from j on are the same; i < j, of one text."""
    i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    top = len(found.ranks) - 1
    for level in range(top, -1, -1):
        ranks, size = found.ranks[level], 1 << level
        go = np.arange(len(i))
        while len(go):
            go = go[j[go] + size <= texts.ends[i[go]]]
            go = go[ranks[i[go]] == ranks[j[go]]]
            i[go], j[go], out[go] = i[go] + size, j[go] + size, out[go] + size
            go = go[j[go] < texts.ends[i[go] - 1]]
            if level < top:
                break
    return out


def agree_backwards(texts: Texts, found: Suffixes, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i and before j are the same; i < j, of one text."""
    begin = texts.firsts[np.searchsorted(texts.firsts, i, "right") - 1]
    i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    top = len(found.ranks) - 1
    for level in range(top, -1, -1):
        ranks, size = found.ranks[level], 1 << level
        go = np.arange(len(i))
        while len(go):
            go = go[i[go] - size >= begin[go]]
            go = go[ranks[i[go] - size] == ranks[j[go] - size]]
            i[go], j[go], out[go] = i[go] - size, j[go] - size, out[go] + size
            if level < top:
                break
    return out


class Wavelet:
    """A wavelet matrix: for ranges of a sequence, how many values are smaller, and the nth smallest, for many queries at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = values >> b & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def smaller(self, lo: np.ndarray, hi: np.ndarray, than: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lo), np.int64)
        for level in range(self.bits):
            ones = self.ones[level]
            a, b = ones[lo], ones[hi]
            set_ = (than >> (self.bits - 1 - level) & 1).astype(bool)
            out += np.where(set_, hi - lo - (b - a), 0)
            lo, hi = np.where(set_, self.zeros[level] + a, lo - a), np.where(set_, self.zeros[level] + b, hi - b)
        return np.where(than >> self.bits > 0, out + hi - lo, out)

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lo), np.int64)
        for level in range(self.bits):
            ones = self.ones[level]
            a, b = ones[lo], ones[hi]
            left = hi - lo - (b - a)
            right = n >= left
            n = np.where(right, n - left, n)
            out = out << 1 | right
            lo, hi = np.where(right, self.zeros[level] + a, lo - a), np.where(right, self.zeros[level] + b, hi - b)
        return out


def candidates(texts: Texts, found: Suffixes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances): of each run of at least `least` words, a place in it with the run's period is among them."""
    n = len(texts.ids)
    low = max(0, (least // 3).bit_length() - 1)  # blocks of so many words find all shorter periods, too
    longest = int(np.diff(texts.firsts).max(initial=0))
    places, distances = [], []
    if low >= len(found.ranks) or 3 << low > longest:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    repeats = found.sizes[low] > 1
    order = found.order[repeats[found.order]]  # what occurs once is in no range that is asked about
    before = np.concatenate([[0], np.cumsum(repeats[found.order])])  # of ranks, in this shorter array
    tree = Wavelet(order, max(1, int(n).bit_length()))
    start = np.repeat(texts.firsts[:-1], np.diff(texts.firsts))
    for level in range(low, len(found.ranks)):
        size = 1 << level
        if 3 * size > longest:
            break
        b = np.flatnonzero(((np.arange(n) - start) % size == 0) & (found.sizes[level] > 1))
        lo = before[found.ranks[level][b]]
        hi = lo + found.sizes[level][b]
        for near, far in [(1, size), (size, 2 * size)] if level == low else [(size, 2 * size)]:
            first = tree.smaller(lo, hi, b + near)
            count = tree.smaller(lo, hi, b + far) - first
            for many in (0, 1):
                at = np.flatnonzero(count > many)
                if many:
                    at = at[count[at] == 2]
                places.append(b[at])
                distances.append(tree.nth(lo[at], hi[at], first[at] + many) - b[at])
            at = np.flatnonzero(count > 2)
            here, x = b[at], tree.nth(lo[at], hi[at], first[at])
            step = tree.nth(lo[at], hi[at], first[at] + 1) - x
            back = agree_backwards(texts, found, x, x + step) - agree_backwards(texts, found, here, here + step)
            fore = agree_forwards(texts, found, x, x + step) - agree_forwards(texts, found, here, here + step)
            for shift in (-back, fore):  # x + shift lies in its stretch of the step as the block does in its own
                fits = shift % step == 0
                places.append(here[fits])
                distances.append((x + shift - here)[fits])
    place, distance = np.concatenate(places), np.concatenate(distances)
    fits = (distance > 0) & (place + distance < texts.ends[place]) if len(place) else np.zeros(0, bool)
    return place[fits], distance[fits]


def runs_of(texts: Texts, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs, sorted; starts are numbers of words in `texts`."""
    if not len(texts.ids):
        return np.zeros((0, 3), np.int64)
    found = suffixes(texts)
    place, period = candidates(texts, found, least)
    begin = place - agree_backwards(texts, found, place, place + period)
    end = place + period + agree_forwards(texts, found, place, place + period)
    long = end - begin >= np.maximum(least, 3 * period)
    rows = np.stack([begin, end - begin, period], axis=1)[long]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    keep = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)) if len(rows) else np.zeros(0, bool)
    rows = rows[keep]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def find_runs(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least: int = LEAST, with_runs: bool = False, with_text: bool = False) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256[, runs][, collapsed]), a row for each row of docs.

    start to exponent_milli are the run's of greatest length / period. runs: (start, length, period) of all, by start, then
    period; collapsed: the words, joined by single spaces, without those that any run holds after its first period.
    """
    if least < 3:
        raise ValueError(f"a run has at least three words, not {least}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            texts, packed, ends = number_words(batch.column("text"))
            rows = runs_of(texts, least)
            edge = np.zeros(len(texts.ids) + 1, np.int64)
            np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
            np.add.at(edge, rows[:, 0] + rows[:, 1], -1)
            kept = np.cumsum(edge[:-1]) == 0
            letters = np.repeat(kept, np.diff(ends))
            own = np.searchsorted(rows[:, 0], texts.firsts)
            out: list[tuple] = []
            for k in range(len(batch)):
                first = int(texts.firsts[k])
                mine = [(a - first, b, q) for a, b, q in rows[own[k] : own[k + 1]].tolist()]
                best = min(mine, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
                a, b = ends[first], ends[texts.firsts[k + 1]]
                left = packed[a:b] if kept[first : texts.firsts[k + 1]].all() else packed[a:b][letters[a:b]]
                left = left[:-1].tobytes()
                listed = "".join(f"{a},{b},{q}\n" for a, b, q in mine)
                out.append((len(mine), *best, 1000 * best[1] // best[2] if mine else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest(), mine, left.decode("utf-8", "replace") if with_text else None))
            n, start, length, period, milli, listed, left, mine, whole = zip(*out, strict=True) if out else [()] * 9
            columns = [batch.column("id"), *(pa.array(x, pa.int64()) for x in (n, start, length, period, milli)), pa.array(listed, pa.string()), pa.array(left, pa.string())]
            names = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            if with_runs:
                columns.append(pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in mine], pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))))
                names.append("runs")
            if with_text:
                columns.append(pa.array(whole, pa.string()))
                names.append("collapsed")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start: long, length: long, period: long>>" * with_runs + ", collapsed string" * with_text
    return over_texts(rows, work, schema).withColumnRenamed("id", id)


def with_planted_runs(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, in which a tenth of the texts, by a hash of the identifier, end in a block that repeats.

    With h = crc32 of the identifier (null: of the empty text), g = h / 10, n words and h % 10 = 0, word i from a = g % n on becomes
    word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8); the words are then joined by single spaces.
    """
    h = F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(found: Column) -> Column:
        n = F.size(found)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(found, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    once = F.transform(F.array(words(F.col(text))), repeated)[0]  # bound to a name, so that a text is split once and not once a word
    return docs.withColumn(text, F.when((h % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]"), once).otherwise(F.col(text)))
