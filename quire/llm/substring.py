"""Removal of repeated passages, by super-k-mers.

A window is k consecutive words of a document. Its minimiser is the smallest hash of the runs of m words in it;
consecutive windows with one minimiser travel as one packed string, a super-k-mer, to the minimiser's bucket.
So all windows of equal words meet in one bucket, about three times the text is moved before compression, and
the strings of a chunk that go to one bucket are compressed together. In the bucket all windows are sorted by hash;
equal hashes are compared in full, byte by byte, and each window's smallest document follows exactly.

Common phrases: a minimiser of many windows, each in other surroundings, would make a bucket as large as its share of
the corpus. So a first pass estimates, from a part of all strings, what goes to each of many classes of minimisers, and to each class of longer ones, the
smallest hashes of runs of `LONGER` words. Windows of a heavy class, of more than a bucket's size or four times the mean, go by their longer minimiser, and where that one's class
is heavy as well, by the hash of all their words, each on its own. Which of the three it is depends on
the window's words alone, so that equal windows still meet. What is broadcast is two bits a class, of at most MOST_CLASSES.

Common passages: where a chunk of text has a super-k-mer in several documents, only the smallest of them goes to
the bucket. The chunk itself decides about the others, which that document suffices to condemn. So a bucket gets
a string once a chunk at most, however many documents share it.

Then a document's spans meet its text in a join, which drops the covered words.

Edge cases: a null text has no words. A text of fewer than k words has no window. Windows repeated within a
document, or in rows of one identifier, are no repeats: no other identifier is smaller. A null identifier counts
as larger than any other. Repeated rows share their spans; rows that repeat an identifier, null included, with other
text are told apart by 128 bits of two hashes of the text. An empty table gives an empty result. A very long text is one unit of a chunk.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import over_texts, partitions_for, small_batches
from quire.llm.ragged import U64, Words, mixed, runs_of, scan_words, sequence_hashes, sliding_min, spans, text_bytes

WINDOW = 13
MINIMISER = 3
LONGER = 8
#: Buckets of a task, so that tasks grow in number, not in size.
TASK_BUCKETS = 4
#: Classes of minimisers: CLASSES for each bucket, but at most MOST_CLASSES, which bounds what is broadcast.
CLASSES = 4
MOST_CLASSES = 1 << 24
#: One in so many strings is weighed. It decides about the way of windows, not about the result.
SAMPLE = 16
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 2 << 20
LAST = np.iinfo(np.int64).max  # stands for a null identifier

SPANS = "id long, tag long, tag2 long, a int, b int"
HEAD = struct.Struct("<qqq")

#: Super-k-mers: document, its two tags, first word, bytes; all their bytes; spans that are known already.
KINDS = (np.int64, np.int64, np.int64, np.int32, np.int32, np.uint8, np.int64, np.int64, np.int64, np.int32, np.int32)


def seal(numbers: list[np.ndarray], body: np.ndarray, done: list[np.ndarray]) -> bytes:
    """One compressed string of a bucket's super-k-mers; numbers lie byte by byte, first the lowest byte of all, then the next."""
    planes = [np.ascontiguousarray(x, kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes() for x, kind in zip((*numbers, body, *done), KINDS, strict=True)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([HEAD.pack(len(numbers[0]), len(body), len(done[0])), *planes]))


def unseal(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, size, ready = HEAD.unpack_from(raw)
    out, place = [], HEAD.size
    for kind, count in zip(KINDS, (*[n] * 5, size, *[ready] * 5), strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, count * width, place).reshape(width, count).T).reshape(-1).view(kind))
        place += count * width
    return out


def same_bytes(body: np.ndarray, a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Which of the spans a are equal to their spans b."""
    equal = a_len == b_len
    some = np.flatnonzero(equal & (a_len > 0))
    if len(some):
        n = a_len[some]
        differs = body[spans(a[some], n)] != body[spans(b[some], n)]
        equal[some] = ~np.logical_or.reduceat(differs, np.cumsum(n) - n)
    return equal


def leaders(hashes: np.ndarray, docs: np.ndarray, body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each span, the smallest document that has an equal one, and the number of a span that it has there."""
    order = np.lexsort((docs, hashes))
    first, count = runs_of(np.append(True, hashes[order][1:] != hashes[order][:-1])) if len(order) else (np.zeros(0, np.int64),) * 2
    lead = np.empty(len(order), np.int64)
    lead[order] = np.repeat(order[first], count)
    repeated = np.flatnonzero(lead != np.arange(len(order)))
    unequal = repeated[~same_bytes(body, starts[repeated], lengths[repeated], starts[lead[repeated]], lengths[lead[repeated]])]
    if len(unequal):  # equal hashes of unequal spans: those groups are told apart by their bytes
        mixed_up = np.isin(hashes, hashes[unequal])
        best: dict[bytes, int] = {}
        for i in order[mixed_up[order]]:
            lead[i] = best.setdefault(body[starts[i] : starts[i] + lengths[i]].tobytes(), i)
    return docs[lead], lead


class Homes(NamedTuple):
    """Where windows go: to one of buckets[0] by their minimiser, those of a heavy class to one of buckets[1] by their longer one, and those of two to one of buckets[2] by all their words."""

    buckets: tuple[int, int, int]
    heavy: tuple[np.ndarray, np.ndarray]  # a bit for each class of minimisers and of longer ones


def is_heavy(bits: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = of % U64(8 * len(bits))
    return bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1 == 1


def least_runs(hashes: np.ndarray, k: int, width: int) -> np.ndarray:
    """The smallest hash of the runs of `width` words in the window of k words that begins at each word."""
    n = len(hashes) - width + 1
    return sliding_min(sequence_hashes(hashes, np.arange(n), np.full(n, width)), k - width + 1)


def homes_of(hashes: np.ndarray, k: int, m: int, longer: int, homes: Homes) -> tuple[np.ndarray, np.ndarray]:
    """(what leads the windows that begin at each word, which of the three it is)"""
    least = least_runs(hashes, k, m)
    heavy = is_heavy(homes.heavy[0], least)
    if not heavy.any():
        return least, heavy.astype(np.int8)
    long = least_runs(hashes, k, longer)
    both = heavy & is_heavy(homes.heavy[1], long)
    return np.where(both, least_runs(hashes, k, k), np.where(heavy, long, least)), heavy.astype(np.int8) + both


class Cut(NamedTuple):
    words: Words
    first: np.ndarray  # word of each super-k-mer
    count: np.ndarray  # its windows
    home: np.ndarray  # what leads it
    level: np.ndarray  # which of the three that is
    start: np.ndarray  # its first byte
    length: np.ndarray


def super_kmers(texts: pa.Array, k: int, m: int, longer: int, homes: Homes) -> Cut | None:
    words = scan_words(*text_bytes(texts))
    n = len(words.starts)
    if n < k:
        return None
    least, level = homes_of(words.hashes, k, m, longer, homes)
    valid = np.arange(n - k + 1) + k <= words.firsts[words.text[: n - k + 1] + 1]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (level[1:] != level[:-1])
    edges = np.flatnonzero(new | ~valid)
    first = edges[valid[edges]]
    if not len(first):
        return None
    count = np.diff(np.append(edges, n - k + 1))[valid[edges]]
    last = first + count + k - 2
    start = words.starts[first]
    return Cut(words, first, count, least[first], level[first], start, words.starts[last] + words.lengths[last] - start)


def bucket_of(home: np.ndarray, level: np.ndarray, homes: Homes) -> np.ndarray:
    sizes = np.array(homes.buckets, U64)
    return (home % sizes[level] + np.concatenate([[U64(0)], np.cumsum(sizes)])[level]).astype(np.int64)


def dealt(batch: pa.RecordBatch, k: int, m: int, longer: int, homes: Homes) -> Iterator[tuple[int, bytes]]:
    """(bucket, its super-k-mers of this chunk)"""
    found = super_kmers(batch.column("text"), k, m, longer, homes)
    if found is None:
        return
    words, first, count, home, level, start, length = found
    text = words.text[first]
    at = (first - words.firsts[text]).astype(np.int32)
    owner, *tags = (batch.column(c).fill_null(LAST).to_numpy()[text] for c in ("id", "tag", "tag2"))
    smallest, _ = leaders(sequence_hashes(words.hashes, first, count + k - 1), owner, words.packed, start, length)
    beaten = owner > smallest
    done = [owner[beaten], *(t[beaten] for t in tags), at[beaten], (at[beaten] + count[beaten] + k - 1).astype(np.int32)]
    bucket = bucket_of(home, level, homes)
    if len(done[0]):
        yield int(words.hashes[0] % U64(homes.buckets[0])), seal([x[:0] for x in (owner, *tags, at, at)], words.packed[:0], done)
    rest = np.flatnonzero(~beaten)
    rest = rest[np.argsort(bucket[rest], kind="stable")]
    own = bucket[rest]
    begins, sizes = runs_of(np.append(True, own[1:] != own[:-1])) if len(own) else ((), ())
    for b, size in zip(begins, sizes, strict=True):
        part = rest[b : b + size]
        yield int(bucket[part[0]]), seal([owner[part], *(t[part] for t in tags), at[part], length[part].astype(np.int32)], words.packed[spans(start[part], length[part])], [x[:0] for x in done])


def bucket_spans(table: pa.Table, k: int) -> pa.Table:
    """The covered spans that a bucket finds."""
    parts = [unseal(x) for x in table.column("blob").to_pylist()]
    docs, tag, tag2, at, lengths, body, *done = (np.concatenate([p[i] for p in parts]) for i in range(len(KINDS)))
    found = [done]
    if len(docs):
        words = scan_words(body, np.append(0, np.cumsum(lengths)))
        n = len(words.starts)
        windows = np.arange(n - k + 1)
        windows = windows[windows + k <= words.firsts[words.text[: n - k + 1] + 1]]
        kmer = words.text[windows]
        start = words.starts[windows]
        length = words.starts[windows + k - 1] + words.lengths[windows + k - 1] - start
        hashes = sequence_hashes(words.hashes, windows, np.full(len(windows), k))
        smallest, _ = leaders(hashes, docs[kmer], words.packed, start, length)
        covered = np.flatnonzero(docs[kmer] > smallest)
        if len(covered):
            first, count = runs_of(np.append(True, (windows[covered][1:] != windows[covered][:-1] + 1) | (kmer[covered][1:] != kmer[covered][:-1])))
            own = kmer[covered[first]]
            a = at[own] + (windows[covered[first]] - words.firsts[own]).astype(np.int32)
            found.append([docs[own], tag[own], tag2[own], a, (a + count + k - 1).astype(np.int32)])
    ids, tag, tag2, a, b = (np.concatenate([f[i] for f in found]) for i in range(5))
    return pa.table({"id": pa.array(ids, mask=ids == LAST), "tag": tag, "tag2": tag2, "a": a, "b": b})


def tagged(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, tag, tag2, text). Where identifiers repeat, the tags tell their texts apart; else they are 0, which costs nothing to move."""
    ids = docs.select(F.col(id).cast("long").alias("id"))
    repeated = ids.groupBy("id").count().where("count > 1").limit(1).count()
    body = F.coalesce(F.col(text), F.lit(""))
    tags = (F.xxhash64(body), F.xxhash64(F.lit("tag"), body)) if repeated else (F.lit(0).cast("long"),) * 2
    return docs.select(F.col(id).cast("long").alias("id"), tags[0].alias("tag"), tags[1].alias("tag2"), F.col(text).alias("text"))


def homes_for(rows: DataFrame, k: int, m: int, longer: int, buckets: int | None, chunk: int, most: int) -> Homes:
    """Estimates the bytes of each class of minimisers and of longer ones, over all rows; of equal strings in a chunk one counts."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(16, -(-size // BUCKET_BYTES))
    classes = min(MOST_CLASSES, 1 << max(12, (CLASSES * buckets - 1).bit_length()))
    light = np.zeros(classes // 8, np.uint8)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", chunk):
            for level, width in enumerate((m, longer)):
                found = super_kmers(batch.column("text"), k, width, longer, Homes((1, 1, 1), (light, light)))
                if found is None:
                    continue
                hashes, one = np.unique(sequence_hashes(found.words.hashes, found.first, found.count + k - 1), return_index=True)
                one = one[mixed(hashes + found.start[one].astype(U64)) % U64(SAMPLE) == 0]
                some, at = np.unique((found.home[one] % U64(classes)).astype(np.int64), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(some + level * classes), pa.array((SAMPLE * np.bincount(at, found.length[one])).astype(np.int64))], ["class", "size"])

    sizes = over_texts(rows.select("text"), weigh, "class long, size long").groupBy("class").agg(F.sum("size").alias("size"))
    large = sizes.where(F.col("size") > (max(most, 4 * size // classes) if most else 0)).toArrow()  # at most two rows a class
    at, size = large.column("class").to_numpy(), large.column("size").to_numpy()
    heavy = np.full(2 * classes, not most)
    heavy[at] = True
    more = [max(1, -(-2 * int(size[at // classes == level].sum()) // max(most, 1 << 14))) for level in (0, 1)]
    # a window that goes on its own has k words, where a super-k-mer has about two a window
    return Homes((buckets, more[0], min(more[0], more[1]) * k // 2 + 1), tuple(np.packbits(x, bitorder="little") for x in np.split(heavy, 2)))


def repeated_spans(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, tag, tag2, a, b): words [a, b) of that row are covered by windows that a document of smaller id has too.

    tag, tag2: as `tagged` has them. A span appears once; spans of one row may touch or overlap. options: of `spans_of`.
    """
    return spans_of(tagged(docs, id, text), **options)


def spans_of(rows: DataFrame, k: int = WINDOW, m: int = MINIMISER, longer: int = LONGER, buckets: int | None = None, chunk: int = CHUNK_BYTES, most: int = BUCKET_BYTES) -> DataFrame:
    longer = max(m, min(longer, k))
    homes = homes_for(rows, k, m, longer, buckets, chunk, most)
    shared = rows.sparkSession.sparkContext.broadcast(homes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", chunk):
            found = list(dealt(batch, k, m, longer, shared.value))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["bucket", "blob"])

    blobs = over_texts(rows, deal, "bucket long, blob binary")
    blobs = blobs.repartition(partitions_for(rows, sum(homes.buckets) // TASK_BUCKETS), "bucket")
    return blobs.groupBy("bucket").applyInArrow(lambda table: bucket_spans(table, k), SPANS)


def apply_spans(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, cuts in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = (text.as_py() or "").encode().split()
            n_words.append(len(words))
            if cuts.is_valid and len(cuts):
                keep = np.ones(len(words), bool)
                for cut in cuts.as_py():
                    keep[cut["a"] : cut["b"]] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        last = pa.array([x.decode() for x in kept], pa.string()) if with_text else pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), last], ["id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", with_text: bool = True, **options) -> DataFrame:
    """One row per row of docs: (id, n_words, n_removed, kept): what is left, words joined by single spaces, or with_text=False its SHA-256."""
    rows = tagged(docs, id, text)
    found = spans_of(rows, **options)
    by_row = found.groupBy(F.col("id").alias("of"), F.col("tag").alias("of_tag"), F.col("tag2").alias("of_tag2")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag")) & (F.col("tag2") == F.col("of_tag2"))
    joined = rows.join(by_row, same, "left").select("id", "text", "spans")
    out = over_texts(joined, lambda batches: apply_spans(batches, with_text), "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id)
