"""Near-duplicates by the Jaccard similarity of word shingles: SimHash links first, then all that these leave open.

A text is the set of its shingles of `SHINGLE` words; two texts are linked if the similarity of their sets is PART / WHOLE
or more. Texts so similar differ in some 10 of 64 SimHash bits on average and up to 20, and so many bits leave a
pigeonring filter nothing to prune by: SimHash alone can't find all links. So it finds what it can, the near ones, and
an exact search does the rest:

1. Of similar texts A has at least ceil(PART / WHOLE * |A|) shingles in the other. Texts that don't have enough of
   their first shingles, in the order of hashes, in any other text leave here; mostly some 80 % of all.
2. Of the others' shingles Spark counts those that are in several texts. Texts with too few of them leave. The rest
   keep their rarest shared ones, as many as make sure that similar texts have one in common: their keys.
3. Fingerprints a few bits apart, found by pigeonring, are compared in full; so is each text's nearest one of
   another component under a key; then all pairs of a key that are still apart and may be similar. Sizes must be alike,
   from the key on enough must be left to overlap, and the parities of `BITS` classes of shingles mustn't differ more
   than the sets may. So a component's members aren't paired off, and only pairs that may be links leave a task.

A key of more than `RUN` texts is split into blocks, and each pair of blocks is a task's group, so that no group is
unbounded. What a large group costs besides is the square of its texts in comparisons of bits, within tasks.

Edge cases: a text of fewer words is one shingle, and so is one without words. Texts that differ only in white
space or in the case of ASCII letters are equal sets. A null identifier is larger than any other. Repeated rows stay
together. An empty table gives an empty result. Shingles are told apart by 63 bits, texts by 128. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, over_texts, small_batches, stored
from quire.llm.ragged import mixed, runs_of, scan_words, sequence_hashes, spans, text_bytes
from quire.llm.simhash import LOWER, links
from quire.operators.graph import connected_components

SHINGLE = 5
#: The least similarity is PART / WHOLE.
PART, WHOLE = 4, 5
#: One shingle more is asked for in the first step for each so many.
STEP = 10
BITS = 1024
RUN = 4096
BLOCK = 256
#: Runs of so many texts are paired off together.
SMALL = 16
BATCH_BYTES = 1 << 20
FOLDED = np.frombuffer(LOWER, np.uint8)


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of all texts, each text's in order; each text's first, one more at the end)"""
    data, offsets = text_bytes(texts)
    words = scan_words(FOLDED[data], offsets)
    counts = np.diff(words.firsts)
    n = np.maximum(counts - shingle + 1, 1)
    hashes = sequence_hashes(words.hashes, spans(words.firsts[:-1], n), np.repeat(np.minimum(counts, shingle), n)) >> np.uint64(1)
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        hashes[a:b].sort()
    new = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
    new[ends - n] = True
    return hashes[new].view(np.int64), np.append(0, np.cumsum(new)[ends - 1])


def least_shared(n: np.ndarray) -> np.ndarray:
    return (n * PART + WHOLE - 1) // WHOLE


def body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def node(text: str) -> Column:
    return F.unhex(F.md5(body(text).cast("binary")))


#: In a row of first shingles: hits * 2^32 + hits that are needed; or this, for a shingle that several texts of a batch have.
MANY = -1


def first_shingles(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(key, mark, info): first shingles that one text of the batch has; one row for each that several have, whose hits are counted here."""
    for batch in small_batches(batches, "text", BATCH_BYTES):
        found, firsts = shingle_sets(batch.column("text"), shingle)
        marks, n = batch.column("mark").to_numpy(), np.diff(firsts)
        need = 1 + least_shared(n) // STEP
        taken = np.minimum(n, n - least_shared(n) + 1 + n // STEP)
        own = np.repeat(np.arange(len(n)), taken)
        keys = found[spans(firsts[:-1], taken)]
        order = np.argsort(keys, kind="stable")
        keys, own = keys[order], own[order]
        first, count = runs_of(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        alone, several = first[count == 1], first[count > 1]
        hits = np.bincount(own[np.repeat(count, count) > 1], minlength=len(n))
        some = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (
            [keys[alone], keys[several], marks[some]], [marks[own[alone]], np.zeros(len(several), np.int64), marks[some]], [need[own[alone]], np.full(len(several), MANY), need[some] + (hits[some] << 32)],
        )], ["key", "mark", "info"])


def count_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, need, hits) from rows in the order of their keys."""
    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        key, mark, info = (batch.column(c).to_numpy() for c in ("key", "mark", "info"))
        counted = info >> 32 > 0
        out = [(mark[counted], info[counted] & 0xFFFFFFFF, info[counted] >> 32)]
        key, mark, info = (np.concatenate([h, x[~counted]]) for h, x in zip(held, (key, mark, info), strict=True))
        if len(key):
            first, count = runs_of(np.append(True, key[1:] != key[:-1]))
            hit = (np.repeat(count, count) > 1) & (info != MANY)
            out.append((mark[hit], info[hit], np.ones(int(hit.sum()), np.int64)))
            held = [key[-1:], mark[-1:], info[-1:] if count[-1] == 1 else np.array([MANY])]
        marks, need, hits = (np.concatenate(x) for x in zip(*out, strict=True))
        some, at = np.unique(marks, return_inverse=True)
        least = np.full(len(some), np.iinfo(np.int64).max)
        np.minimum.at(least, at, need)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(least), pa.array(np.bincount(at, hits, len(some)).astype(np.int64))], ["mark", "need", "hits"])


def sharing(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """(mark): hashes of the texts that may be similar to another by their first shingles."""
    rows = docs.select(F.xxhash64(body(text)).alias("mark"), body(text).alias("text"))
    dealt = over_texts(rows, lambda batches: first_shingles(batches, shingle), "key long, mark long, info long")
    counted = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(count_hits, "mark long, need long, hits long")
    return counted.groupBy("mark").agg(F.sum("hits").alias("hits"), F.min("need").alias("need")).where("hits >= need").select("mark")


def sets_of(docs: DataFrame, marks: DataFrame, text: str, shingle: int) -> DataFrame:
    """(ref, node, n, shingles, bits, print) of each distinct text of marks; ref is a number of its own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            found, firsts = shingle_sets(batch.column("text"), shingle)
            n = np.diff(firsts)
            own = np.repeat(np.arange(len(n)), n)
            parity = np.bincount(own * BITS + (found & (BITS - 1)), minlength=len(n) * BITS) & 1
            packed = np.packbits(parity.astype(np.uint8))
            width = np.arange(len(n) + 1) * (BITS // 8)
            bits = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(width), pa.py_buffer(packed)]).cast(pa.binary())
            signs, prints = mixed(found.view(np.uint64)), np.zeros(len(n), np.uint64)
            for i in range(64):
                ones = np.add.reduceat((signs >> np.uint64(i) & np.uint64(1)).astype(np.int32), firsts[:-1])
                prints |= (2 * ones > n).astype(np.uint64) << np.uint64(i)
            sets = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(found))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n.astype(np.int32)), sets, bits, pa.array(prints.view(np.int64))], ["node", "n", "shingles", "bits", "print"])

    rows = docs.select(node(text).alias("node"), body(text).alias("text"), F.xxhash64(body(text)).alias("mark"))
    rows = rows.join(marks, "mark", "left_semi").select("node", "text")
    made = over_texts(rows, work, "node binary, n int, shingles array<long>, bits binary, print long")
    return stored(made.dropDuplicates(["node"]).withColumn("ref", F.monotonically_increasing_id()))


def keyed(sets: DataFrame) -> DataFrame:
    """(ref, n, bits, print, place, keys): texts with enough shared shingles, and the rarest of these; place is the first key's among all its shingles."""
    each = sets.select("ref", F.explode("shingles").alias("key"))
    common = stored(each.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"))
    shared = each.join(common, "key").groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("times", "key"))).alias("keys"))
    enough = F.size("keys") - F.floor((F.col("n") * PART + WHOLE - 1) / WHOLE)
    found = shared.join(sets.select("ref", "n", "bits", "print"), "ref").where(enough >= 0)
    return stored(found.select("ref", "n", "bits", "print", (F.col("n") - F.size("keys")).alias("place"), F.slice("keys", 1, (enough + 1).cast("int")).alias("keys")))


def maybe(rows: dict, a, b) -> tuple[np.ndarray, np.ndarray]:
    """(whether rows a and b may be a link between components, their difference in bits by the greatest that it may be)"""
    n, m = rows["n"][a], rows["n"][b]
    rest = np.minimum(n - rows["place"][a], m - rows["place"][b])
    bits = np.bitwise_count(rows["bits"][a] ^ rows["bits"][b]).sum(axis=-1, dtype=np.int64)
    total = n + m
    ok = (rows["label"][a] != rows["label"][b]) & (WHOLE * np.minimum(n, m) >= PART * np.maximum(n, m)) & ((PART + WHOLE) * rest >= PART * total)
    ok &= (rows["block"][a] != rows["block"][b]) | rows["whole"][a]
    return ok & (bits * (PART + WHOLE) <= (WHOLE - PART) * total), bits / total


def pairs_of_run(rows: dict, start: int, end: int, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a long run: all that may be links, or of each text the nearest."""
    blocks = [np.arange(i, min(i + BLOCK, end)) for i in range(start, end, BLOCK)]
    for i, one in enumerate(blocks):
        best, best_at = np.full(len(one), np.inf), np.zeros(len(one), np.int64)
        for other in blocks[: i + 1] if every else blocks:
            if np.unique(rows["label"][np.concatenate([one, other])]).size == 1:
                continue
            ok, far = maybe(rows, one[:, None], other[None, :])
            if every:
                a, b = np.nonzero(ok & (one[:, None] > other[None, :]))
                yield one[a], other[b]
            else:
                far = np.where(ok, far, np.inf)
                at = far.argmin(axis=1)
                nearer = far[np.arange(len(one)), at] < best
                best[nearer], best_at[nearer] = far[np.arange(len(one)), at][nearer], other[at][nearer]
        if not every:
            some = np.flatnonzero(np.isfinite(best))
            yield one[some], best_at[some]


def pairs_of_keys(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """(u, v) from entries in the order of key, cell and label; a pair once a batch at most."""
    names = ["key", "cell", "block", "whole", "ref", "label", "n", "place"]
    held: dict | None = None

    def found(rows: dict, first: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        run = np.repeat(np.arange(len(first)), count)
        run = np.where(count[run] <= SMALL, run, -1 - np.arange(len(run)))
        for d in range(1, min(SMALL, int(count.max(initial=0)))):
            a = np.flatnonzero(run[d:] == run[: len(run) - d])
            ok = maybe(rows, a, a + d)[0]
            pairs.append((a[ok], a[ok] + d))
        for start, size in zip(first[count > SMALL].tolist(), count[count > SMALL].tolist(), strict=True):
            pairs += pairs_of_run(rows, start, start + size, every)
        a, b = (rows["ref"][np.concatenate(x)] for x in zip(*pairs, strict=True))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in range(2)], ["u", "v"])

    for batch in batches:
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        now["n"], now["place"] = now["n"].astype(np.int64), now["place"].astype(np.int64)
        now["bits"] = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        held = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in now}
        if not len(held["key"]):
            continue
        first, count = runs_of(np.append(True, (held["key"][1:] != held["key"][:-1]) | (held["cell"][1:] != held["cell"][:-1])))
        yield found({c: x[: first[-1]] for c, x in held.items()}, first[:-1], count[:-1])
        held = {c: x[first[-1] :] for c, x in held.items()}  # the last run may go on; RUN bounds it
    if held is not None and len(held["key"]):
        yield found(held, np.zeros(1, np.int64), np.array([len(held["key"])]))


def candidates(texts: DataFrame, labels: DataFrame, every: bool) -> DataFrame:
    """(u, v): pairs of texts (from `keyed`) that share a key, are in no component together by labels, and may be similar."""
    rows = texts.join(labels, F.col("ref") == F.col("node"), "left").select("ref", F.coalesce("component", "ref").alias("label"), "n", "bits", "place", F.posexplode("keys").alias("at", "entry"))
    # a key whose texts are all of one component has nothing left to tell, however many they are
    labelled = rows.select(F.col("entry.key").alias("key"), "label")
    open_keys = stored(labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"))
    rows = rows.join(open_keys, F.col("entry.key") == F.col("key"), "left_semi")
    parts = F.ceil(F.col("entry.times") / RUN).cast("int")
    rows = rows.select("ref", "label", "n", "bits", (F.col("place") + F.col("at")).alias("place"), F.col("entry.key").alias("key"), parts.alias("parts"), F.pmod(F.xxhash64("ref"), parts).cast("int").alias("block"))
    # blocks i and j of a long run meet in one cell, which is i's own if they are the same
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least("block", j) * F.col("parts") + F.greatest("block", j))
    rows = rows.select("key", F.explode(cells).alias("cell"), "block", "parts", "ref", "label", "n", "place", "bits")
    rows = rows.select("key", "cell", "block", (F.col("cell") % (F.col("parts") + 1) == 0).alias("whole"), "ref", "label", "n", "place", "bits")
    dealt = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "label")
    return dealt.mapInArrow(lambda batches: pairs_of_keys(batches, every), "u long, v long").distinct()


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """(u, v): texts of equal fingerprint, and of fingerprints that pigeonring finds to be a few bits apart."""
    reps = cut(texts.groupBy("print").agg(F.min("ref").alias("rep")))
    equal = texts.join(reps, "print").where("ref <> rep").select(F.col("rep").alias("u"), F.col("ref").alias("v"))
    a, b = (reps.select(F.col("print").alias(p), F.col("rep").alias(r)) for p, r in (("u", "a"), ("v", "b")))
    return equal.union(links(reps.select("print")).join(a, "u").join(b, "v").select(F.least("a", "b"), F.greatest("a", "b"))).distinct()


def similar(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Which of pairs (u, v) are similar, by all of their shingles."""
    a, b = (sets.select(F.col("ref").alias(of), F.col("shingles").alias(name)) for of, name in (("u", "a"), ("v", "b")))
    both = stored(pairs).join(a, "u").join(b, "v")
    return both.where((PART + WHOLE) * F.size(F.array_intersect("a", "b")) >= PART * (F.size("a") + F.size("b"))).select("u", "v")


def components(sets: DataFrame) -> DataFrame:
    """(node, component) of the texts, by ref, that are similar to another."""
    texts = keyed(sets)
    linked = stored(similar(sets, fingerprint_pairs(texts)))
    for every in (False, True):
        labels = stored(connected_components(linked, "u", "v"))
        # a component goes on as a star, so that its links aren't drawn together again
        stars = labels.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        linked = stored(stars.union(similar(sets, candidates(texts, labels, every))))
    return connected_components(linked, "u", "v")


def drop_near_copies(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs with the smallest identifier among the texts that similar ones lead to; rows that share it all stay."""
    sets = sets_of(docs, stored(sharing(docs, text, shingle)), text, shingle)
    names = sets.select("node", "ref").join(components(sets).withColumnRenamed("node", "of"), F.col("ref") == F.col("of"), "left")
    names = stored(names.select("node", F.coalesce("component", "ref").alias("component")))
    rows = docs.select(F.col(id).alias("__id"), node(text).alias("node"))
    named = stored(rows.join(names, "node").select("__id", F.col("node").alias("__node"), "component"))
    least = named.groupBy("component").agg(F.min("__id").alias("least"), F.count("*").alias("n")).where("n > 1")
    goes = stored(named.join(least, "component").where(~F.col("__id").eqNullSafe(F.col("least"))).select("__id", "__node").distinct())
    return docs.join(goes, F.col(f"`{id}`").eqNullSafe(F.col("__id")) & (node(text) == F.col("__node")), "left_anti")
