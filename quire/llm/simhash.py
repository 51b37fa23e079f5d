"""Near-duplicates by SimHash, links found by pigeonring filtering.

The 64 bits are a ring of `SEGMENTS` segments. If two fingerprints differ in at most `most` bits, then from some
segment on, every chain of l consecutive segments differs in at most l * most / SEGMENTS bits, for each l. With 8
segments and 3 bits: the first two segments are equal, the first five differ in one bit at most, and so on. A key
is a start and those segments of the chain that must be equal in one of the ways to spend the chain's budget; pairs
with an equal key are tested along the whole ring, and what survives by the full Hamming distance.

Copies and texts of equal fingerprint are one row from the first shuffle on. The fingerprints of one key are not
paired off: long runs are split by parts of their other bits, what is left is walked in blocks, and only the links that join what was apart before leave the task (a
forest, fewer links than fingerprints), which keeps every component. Components follow from these links by
alternating large-star and small-star steps, in tables that are cut in the shared folder.

Edge cases: a text without words (null, empty, white space) has fingerprint 0 and is linked like any other. A null
identifier is larger than any other; a component of nothing else has a null component_id. Repeated rows give
repeated rows. An empty table gives an empty result. A very long text is hashed in slices. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, over_texts
from quire.operators.graph import connected_components

SHINGLE = 3
SEED = 42
MOST = 3
SEGMENTS = 8
CHAIN = 5
SLICE = 1 << 16
#: A run of more fingerprints is split by further bits.
LONG = 4096

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit number."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n = len(words) - shingle + 1
    hashes = map(partial(xxhash.xxh64_intdigest, seed=seed), map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle)), strict=False)))
    ones = np.zeros(64, np.int64)
    for start in range(0, n, SLICE):
        part = np.fromiter(hashes if n <= SLICE else islice(hashes, SLICE), np.uint64, min(SLICE, n - start))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, print): each row's fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py(), shingle, seed) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.int64())], ["id", "print"])

    return over_texts(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), work, "id long, print long")


def budgets(segments: int = SEGMENTS, most: int = MOST) -> list[int]:
    """The differing bits that a chain of 1, 2, ... segments may have."""
    return [length * most // segments for length in range(1, segments + 1)]


def chain_mask(start: int, places: Iterator[int], segments: int) -> int:
    width = 64 // segments
    return sum(((1 << width) - 1) << (width * ((start + i) % segments)) for i in places)


def key_masks(segments: int = SEGMENTS, most: int = MOST, chain: int = CHAIN) -> list[tuple[int, int]]:
    """(start, mask): the segments that are equal, for each start and each way to place a chain's differing segments."""
    if 64 % segments or most >= segments or not 0 < chain <= segments:
        raise ValueError("segments must divide 64 and be more than the differing bits; a chain has 1 to all of them")
    allowed, masks = budgets(segments, most), {}
    for apart in combinations(range(chain), allowed[chain - 1]):
        if all(sum(i < length for i in apart) <= allowed[length - 1] for length in range(1, chain + 1)):
            for start in range(segments):
                masks.setdefault(chain_mask(start, [i for i in range(chain) if i not in apart], segments), start)
    return [(start, mask) for mask, start in masks.items()]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near(a: np.ndarray, b: np.ndarray, start: int, segments: int, most: int) -> np.ndarray:
    """Which of a link with which of b: along the ring from start, each chain only for what the shorter ones leave, then in all."""
    differs = (a[:, None] ^ b[None, :]).reshape(-1)
    allowed = budgets(segments, most)
    longest = [n for n in range(1, segments) if allowed[n] > allowed[n - 1]]  # of each budget but the last
    left = None
    for length in longest:
        mask = np.uint64(chain_mask(start, range(length), segments))
        some = differs if left is None else differs[left]
        passed = np.flatnonzero(np.bitwise_count(some & mask) <= allowed[length - 1])
        left = passed if left is None else left[passed]
    left = np.arange(len(differs)) if left is None else left
    found = np.zeros(len(differs), bool)
    found[left[np.bitwise_count(differs[left]) <= most]] = True
    return found.reshape(len(a), len(b))


def forest(prints: np.ndarray, start: int, segments: int, most: int, block: int = 1024) -> list[tuple[int, int]]:
    """Links that join what `near` joins, each fingerprint to the smallest that it reaches here; block by block."""
    label = np.arange(len(prints))
    blocks = [slice(i, min(i + block, len(prints))) for i in range(0, len(prints), block)]
    for i, one in enumerate(blocks):
        for other in blocks[: i + 1]:
            linked = near(prints[one], prints[other], start, segments, most)
            while True:
                mine, theirs = label[one], label[other]
                mine = np.minimum(mine, np.where(linked, theirs[None, :], len(prints)).min(axis=1))
                theirs = np.minimum(theirs, np.where(linked, mine[:, None], len(prints)).min(axis=0))
                lower = np.arange(len(prints))  # what a label's own fingerprint has come to
                np.minimum.at(lower, label[one], mine)
                np.minimum.at(lower, label[other], theirs)
                lower = lower[lower]
                label_new = np.minimum(label, lower[label])
                label_new[one] = np.minimum(label_new[one], mine)
                label_new[other] = np.minimum(label_new[other], theirs)
                if (label_new == label).all():
                    break
                label = label_new
    return [(int(prints[i]), int(prints[label[i]])) for i in np.flatnonzero(label != np.arange(len(prints)))]


def run_links(prints: np.ndarray, start: int, free: list[int], segments: int, most: int, limit: int = LONG) -> list[tuple[int, int]]:
    """Links within a run, whose fingerprints may differ in the bits `free`.

    A run of more than `limit` is split: of most + 1 parts of the free bits, two near fingerprints have one in common, so
    it is enough to look at those that agree in the first part, then at those in the second, and so on.
    """
    if len(prints) <= limit or len(free) < 2 * (most + 1):
        return forest(prints, start, segments, most)
    found = []
    for i in range(most + 1):
        part = free[i :: most + 1]
        value = prints & np.uint64(sum(1 << b for b in part))
        order = np.argsort(value, kind="stable")
        edges = np.flatnonzero(np.append(True, value[order][1:] != value[order][:-1]))
        rest = [b for b in free if b not in part]
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(prints)], strict=True):
            if b - a > 1:
                found += run_links(np.sort(prints[order[a:b]]), start, rest, segments, most, limit)
    return found


def links_of_runs(batches: Iterator[pa.RecordBatch], masks: list[tuple[int, int]], segments: int, most: int) -> Iterator[pa.RecordBatch]:
    """From rows (way, key, print) in order: the links within each run of one way and key. A run that batches part is put together once."""
    free = [[b for b in range(64) if not mask >> b & 1] for _, mask in masks]
    held: list[np.ndarray] = []  # parts of the last run
    last = None

    def found(way: int, parts: list[np.ndarray]) -> list[tuple[int, int]]:
        prints = np.concatenate(parts).view(np.uint64)
        return run_links(prints, masks[way][0], free[way], segments, most) if len(prints) > 1 else []

    for batch in _and_end(batches):
        pairs: list[tuple[int, int]] = []
        if batch is None:
            if held:
                pairs = found(last[0], held)
        elif len(batch):
            way, key, prints = (np.ascontiguousarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("way", "key", "print"))
            edges = np.flatnonzero(np.append(True, (way[1:] != way[:-1]) | (key[1:] != key[:-1])))
            ends = np.append(edges[1:], len(way))
            if last != (way[0], key[0]) and held:
                pairs += found(last[0], held)
                held = []
            if held and len(edges) > 1:  # the run of the batch before ends here
                pairs += found(last[0], [*held, prints[: ends[0]]])
                held, edges, ends = [], edges[1:], ends[1:]
            for a, b in zip(edges[:-1].tolist(), ends[:-1].tolist(), strict=True):
                if b - a > 1:
                    pairs += found(way[a], [prints[a:b]])
            held.append(prints[edges[-1] :])
            last = (way[-1], key[-1])
        if pairs:
            both = np.array(pairs, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(prints: DataFrame, *, most: int = MOST, segments: int = SEGMENTS, chain: int = CHAIN) -> DataFrame:
    """(u, v): links of distinct fingerprints (column print) that have the components of all pairs `most` bits apart."""
    masks = key_masks(segments, most, chain)
    ways = F.explode(F.array(*[F.struct(F.lit(i).alias("way"), F.col("print").bitwiseAND(F.lit(signed(m))).alias("key")) for i, (_, m) in enumerate(masks)]))
    keyed = prints.select("print", ways.alias("w")).select("w.way", "w.key", "print")
    runs = keyed.repartition("way", "key").sortWithinPartitions("way", "key", "print")
    return runs.mapInArrow(lambda batches: links_of_runs(batches, masks, segments, most), "u long, v long").distinct()


def hex_print(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def near_groups(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, most: int = MOST, segments: int = SEGMENTS, chain: int = CHAIN) -> DataFrame:
    """One row per row of docs: (id, fingerprint, component_id), the latter the smallest identifier that links reach."""
    rows = cut(fingerprints(docs, id=id, text=text, shingle=shingle, seed=seed))
    prints = cut(rows.groupBy("print").agg(F.min("id").alias("least")))
    components = connected_components(links(prints, most=most, segments=segments, chain=chain), "u", "v")
    rooted = prints.join(components, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    smallest = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "component").select(F.col("print").alias("of"), "component_id")
    joined = rows.join(named, F.col("print") == F.col("of"))
    return joined.select(F.col("id").alias(id), hex_print(F.col("print")).alias("fingerprint"), "component_id")
