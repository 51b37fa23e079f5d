"""Language-model scores from classes of words (Brown's class n-grams).

log10 P(text) is the sum over its words and one end of log10 P(class | class before) + log10 P(word | class).

* Exchange clustering puts each training word into one of CLASSES classes. What is maximised is the information that a word's class has about its left
  and right neighbours, over all tokens: sum of n log n of each class with each neighbour, less that of the class's size. Neighbours are told apart
  if they are among the CONTEXTS most frequent words or the end of a text, and are one kind otherwise, so that these sums are a table of fixed size. In a round
  half of the words, by hash, go to the class where they raise the sums most, each taken out of its own first. The first classes are those
  of the most frequent words. A word's class is a function of its own neighbours and of the rounds' tables, so that no round needs to store
  classes, and of all rounds' the best tables stay.
* Class transitions are counted over all training tokens and mixed with class frequencies (Witten-Bell). Words seen once stand, besides,
  for words never seen: a class of its own has their counts before and after it. So the probabilities of all words and one unknown word sum to one.
* Texts are read once into chunks with a word list each; what is known of words (count, class) is joined to these lists, and never as a whole
  sent to anyone. A word is once in a chunk's list, so no key of these joins is hot. Counts and sums are taken over all training rows, in the chunk first.

Edge cases: a null or empty text has its end only. Rows train by the hash of their identifier (null: of the empty text), repeated rows each. If nothing
trains, every word is the one unknown word, of probability one. A very long text is read whole. Ties of frequency go to the smaller word, of gain to
the smaller class. An empty table gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import over_texts, shared_dir, small_batches, stored
from quire.llm.ragged import scan_words, spans, text_bytes

CLASSES = 64
CONTEXTS = 256
ROUNDS = 6
CHUNK_BYTES = 6 << 20
#: Words whose classes are looked for at once, and their neighbours: batches are put together up to either.
WORDS_AT_ONCE = 8_000
ENTRIES_AT_ONCE = 60_000
END = 0
#: A token of a word that training saw once has this added to its class.
ONCE = 128


def held_out(id: str):
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def packed(tokens: np.ndarray) -> bytes:
    """Small numbers, their lowest bytes first, then the next ones."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(tokens.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view(np.int32)


def chunked(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(chunk, ids, held, sizes, tokens, words, counts): texts as numbers of words of the chunk's own list; counts are those of training rows."""
    rows = docs.select(F.col(id).alias("id"), held_out(id).alias("held"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nth, batch in enumerate(small_batches(batches, "text", CHUNK_BYTES)):
            data, offsets = text_bytes(batch.column("text"))
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
            found = scan_words(data, offsets, hashed=False)
            n = len(found.starts)
            ends = np.append(found.starts, len(found.packed)).astype(np.int64)
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(found.packed)]).dictionary_encode()
            of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
            held = batch.column("held").to_numpy(zero_copy_only=False)
            distinct = len(coded.dictionary)
            often = np.bincount(of, minlength=distinct)
            order = np.argsort(-often, kind="stable")  # frequent words have small numbers, which compress well
            place = np.empty(distinct, np.int32)
            place[order] = np.arange(distinct)
            tokens = place[of]
            counts = np.bincount(tokens[~held[found.text]], minlength=distinct)
            words = pc.binary_slice(coded.dictionary.take(pa.array(order)).cast(pa.large_binary()), 0, -1).cast(pa.string())
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() << 32 | nth]), one(batch.column("id")), one(batch.column("held")), one(pa.array(np.diff(found.firsts).astype(np.int32))), pa.array([packed(tokens)], pa.binary()), one(words), one(pa.array(counts.astype(np.int32)))],
                ["chunk", "ids", "held", "sizes", "tokens", "words", "counts"],
            )

    path = f"{shared_dir(docs.sparkSession)}/chunks-{uuid.uuid4().hex}"
    made = over_texts(rows, work, f"chunk long, ids array<{kind}>, held array<boolean>, sizes array<int>, tokens binary, words array<string>, counts array<int>")
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def count_words(chunks: DataFrame) -> DataFrame:
    """(word, c) of all training words."""
    pairs = chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("p")).select("p.words", "p.counts").where("counts > 0")
    return stored(pairs.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c")))


class Chunk(NamedTuple):
    tokens: np.ndarray
    sizes: np.ndarray
    held: np.ndarray
    firsts: np.ndarray  # of each text; one more at the end


def read_chunk(tokens: bytes, sizes: list[int], held: list[bool]) -> Chunk:
    counts = np.array(sizes, np.int64)
    return Chunk(unpacked(tokens), counts, np.array(held, bool), np.concatenate([[0], np.cumsum(counts)]))


def neighbours(chunks: DataFrame, frequent: list[str]) -> DataFrame:
    """(word, j, n): how often training words have frequent neighbour j % (CONTEXTS + 2), on the left (j below that) or right; 0 is the end, 1 the first frequent word."""
    shared = chunks.sparkSession.sparkContext.broadcast(frequent)  # CONTEXTS words
    side = CONTEXTS + 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value, pa.string())
        for batch in batches:
            for row in range(len(batch)):
                words = batch.column("words")[row].values
                chunk = read_chunk(batch.column("tokens")[row].as_py(), batch.column("sizes")[row].as_py(), batch.column("held")[row].as_py())
                kind = pc.fill_null(pc.index_in(words, names), -2).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                known = kind[chunk.tokens]
                left, right = np.roll(known, 1), np.roll(known, -1)
                some = chunk.sizes > 0
                left[chunk.firsts[:-1][some]] = END
                right[chunk.firsts[1:][some] - 1] = END
                learns = np.repeat(~chunk.held, chunk.sizes)
                codes = [chunk.tokens[use].astype(np.int64) * (2 * side) + at * side + of[use] for at, of in ((0, left), (1, right)) for use in [learns & (of >= 0)]]
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                for a in range(0, len(code), 1 << 17):
                    cut = code[a : a + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(cut // (2 * side))), pa.array((cut % (2 * side)).astype(np.int32)), pa.array(n[a : a + (1 << 17)].astype(np.int64))], ["word", "j", "n"])

    found = over_texts(chunks.select("words", "tokens", "sizes", "held"), work, "word string, j int, n long")
    return found.groupBy("word", "j").agg(F.sum("n").alias("n"))


def entropy(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


class Words(NamedTuple):
    """Some words with their neighbours, one word after the other."""

    c: np.ndarray
    half: np.ndarray  # whether a word moves in even rounds
    firsts: np.ndarray  # of each word, its first entry
    j: np.ndarray
    n: np.ndarray


def read_words(batch: pa.RecordBatch) -> Words:
    """Adds, on either side, the neighbours that aren't frequent."""
    side = CONTEXTS + 2
    c = batch.column("c").to_numpy(zero_copy_only=False).astype(np.int64)
    lists = batch.column("near")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    j, n = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("j", "n"))
    own = np.repeat(np.arange(len(c)), sizes)
    rest = np.concatenate([c - np.bincount(own[(j >= side) == s], n[(j >= side) == s], len(c)).astype(np.int64) for s in (False, True)])
    own = np.concatenate([own, np.arange(len(c)), np.arange(len(c))])
    j = np.concatenate([j, np.full(len(c), side - 1), np.full(len(c), 2 * side - 1)])
    order = np.argsort(own, kind="stable")
    n = np.concatenate([n, rest])
    order = order[n[order] > 0]
    half = batch.column("half").to_numpy(zero_copy_only=False)
    return Words(c, half, np.searchsorted(own[order], np.arange(len(c))), j[order], n[order])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows, entries = [], 0, 0
    for batch in batches:
        held, rows, entries = [*held, batch], rows + len(batch), entries + len(batch.column("near").flatten())
        if rows >= WORDS_AT_ONCE or entries >= ENTRIES_AT_ONCE:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, entries = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def gains(words: Words, table: np.ndarray) -> np.ndarray:
    """What each word adds to the sums in each class; table: class, neighbour."""
    size = table[:, : CONTEXTS + 2].sum(axis=1)
    pair, at = np.unique(words.j << 40 | words.n, return_inverse=True)
    j, n = pair >> 40, pair & ((1 << 40) - 1)
    add = entropy(table[:, j] + n) - entropy(table[:, j])
    return np.add.reduceat(np.ascontiguousarray(add.T)[at], words.firsts, axis=0) - 2 * (entropy(size + words.c[:, None]) - entropy(size))


def own_gain(words: Words, table: np.ndarray, of: np.ndarray) -> np.ndarray:
    """What each word adds in the class that has it."""
    size = table[:, : CONTEXTS + 2].sum(axis=1)[of]
    have = table[np.repeat(of, np.diff(np.append(words.firsts, len(words.j)))), words.j]
    return np.add.reduceat(entropy(have) - entropy(have - words.n), words.firsts) - 2 * (entropy(size) - entropy(size - words.c))


def classes_of(words: Words, tables: list[np.ndarray]) -> np.ndarray:
    """The class of each word after the rounds of these tables; words seen once between the same neighbours, of one half, are worked out once."""
    once = words.c == 1
    lengths = np.diff(np.append(words.firsts, len(words.j)))
    own = np.repeat(np.arange(len(once)), lengths)
    side = CONTEXTS + 2
    place = np.where(words.j < side, words.j, (words.j - side) * side) * (words.n > 0)
    between = np.bincount(own, place, len(once))[once].astype(np.int64) * 2 + words.half[once]
    _, first, same = np.unique(between, return_index=True, return_inverse=True)
    often = np.flatnonzero(~once)
    pick = np.concatenate([often, np.flatnonzero(once)[first]])
    at = spans(words.firsts[pick], lengths[pick])
    found = classes_of_each(Words(words.c[pick], words.half[pick], np.cumsum(lengths[pick]) - lengths[pick], words.j[at], words.n[at]), tables)
    of = np.empty(len(once), found.dtype)
    of[often], of[once] = found[: len(often)], found[len(often) :][same]
    return of


def classes_of_each(words: Words, tables: list[np.ndarray]) -> np.ndarray:
    """The class of each word after the rounds of these tables, the first of which has the first words' neighbours only."""
    of = gains(words, tables[0]).argmax(axis=1)
    for k, table in enumerate(tables[1:]):
        move = np.flatnonzero(words.half == (k % 2 == 0))
        if not len(move):
            continue
        lengths = np.diff(np.append(words.firsts, len(words.j)))
        entries = np.repeat(words.half == (k % 2 == 0), lengths)
        part = Words(words.c[move], words.half[move], np.cumsum(lengths[move]) - lengths[move], words.j[entries], words.n[entries])
        gain = gains(part, table)
        gain[np.arange(len(move)), of[move]] = own_gain(part, table, of[move])
        best = gain.argmax(axis=1)
        better = gain[np.arange(len(move)), best] > gain[np.arange(len(move)), of[move]] + 1e-9
        of[move] = np.where(better, best, of[move])
    return of


def value(table: np.ndarray) -> float:
    return float(entropy(table).sum() - 2 * entropy(table[:, : CONTEXTS + 2].sum(axis=1)).sum())


def cluster(known: DataFrame, first: list[str], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The tables of the rounds up to the best; known: (word, c, half, near)."""
    spark, width = known.sparkSession, 2 * (CONTEXTS + 2)

    def table_of(tables: list[np.ndarray]) -> np.ndarray:
        shared = spark.sparkContext.broadcast(tables)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(CLASSES * width, np.int64)
            for batch in gathered(batches):
                if len(batch):
                    words = read_words(batch)
                    of = np.repeat(classes_of(words, shared.value), np.diff(np.append(words.firsts, len(words.j))))
                    total += np.bincount(of * width + words.j, words.n, len(total)).astype(np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

        rows = known.select("c", "half", "near").mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # CLASSES * width rows at most
        table = np.zeros(CLASSES * width)
        table[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
        return table.reshape(CLASSES, width)

    start = np.zeros((CLASSES, width))
    place = {w: i for i, w in enumerate(first)}
    seeds = known.where(F.col("word").isin(first)).select("word", "c", "half", "near").toArrow().combine_chunks()  # CLASSES rows
    for batch in seeds.to_batches():
        words = read_words(batch)
        of = np.repeat([place[w] for w in batch.column("word").to_pylist()], np.diff(np.append(words.firsts, len(words.j))))
        np.add.at(start, (of, words.j), words.n)
    tables, values = [start], [-np.inf]
    for _ in range(rounds):
        tables.append(table_of(tables))
        values.append(value(tables[-1]))
    return tables[: max(1, int(np.argmax(values)))]  # the best table is what these make


def assigned(known: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """(word, c, class), classes from 1 on."""
    shared = known.sparkSession.sparkContext.broadcast(tables)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            of = classes_of(read_words(batch), shared.value) + 1 if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(of, pa.int32())], ["word", "c", "class"])

    return stored(known.select("word", "c", "half", "near").mapInArrow(work, "word string, c long, class int"))


class Totals(NamedTuple):
    tokens: int
    words: int
    texts: int  # of training
    classes: np.ndarray  # tokens of each


def labelled(chunks: DataFrame, found: DataFrame, totals: Totals) -> DataFrame:
    """(id, held, n_tokens, n_known, base, emission, classes): a row a text, its tokens' classes as bytes."""
    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    unseen = CLASSES + 1
    links = chunks.select(F.col("chunk").alias("of"), F.posexplode("words").alias("at", "word")).join(found, "word").select("of", "at", "c", "class")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, out = [], {n: [] for n in ("held", "n_tokens", "n_known", "base", "emission", "classes")}
        at, c, of = (right.column(n).to_numpy() for n in ("at", "c", "class"))
        for row in range(left.num_rows):
            chunk = read_chunk(*(left.column(n)[row].as_py() for n in ("tokens", "sizes", "held")))
            ids.append(left.column("ids")[row].values)
            size = int(chunk.tokens.max(initial=-1)) + 1
            counts, classes = np.zeros(size, np.int64), np.full(size, unseen)
            counts[at], classes[at] = c, of
            base = np.log10((counts + 1) / (totals.tokens + totals.words + 1))
            emission = np.where(counts > 0, np.log10(np.maximum(counts, 1) / np.maximum(totals.classes[classes], 1)), 0.0)
            classes = (classes + ONCE * (counts == 1)).astype(np.uint8)[chunk.tokens]
            own = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
            total = lambda x: np.bincount(own, x[chunk.tokens], len(chunk.sizes))
            out["held"] += chunk.held.tolist()
            out["n_tokens"] += (chunk.sizes + 1).tolist()
            out["n_known"] += (total((counts > 0).astype(float)).astype(np.int64) + (totals.texts > 0)).tolist()
            out["base"] += (total(base) + np.log10((totals.texts + 1) / (totals.tokens + totals.words + 1))).tolist()
            out["emission"] += total(emission).tolist()
            out["classes"] += [classes[a:b].tobytes() for a, b in zip(chunk.firsts[:-1], chunk.firsts[1:], strict=True)]
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        return pa.table([pa.chunked_array(ids), *(pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True))], ["id", *out])

    both = chunks.select("chunk", "ids", "held", "sizes", "tokens").groupBy("chunk").cogroup(links.groupBy("of"))
    return stored(both.applyInArrow(work, f"id {kind}, held boolean, n_tokens long, n_known long, base double, emission double, classes binary"))


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(classes of all texts, an end before each and one after the last; where each text's first token is)"""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    return np.append(np.insert(data, offsets[:-1], END), END), offsets + np.arange(len(offsets))


def transitions(texts: DataFrame) -> np.ndarray:
    """Counts of class after class over the training texts; those of the unseen class are those of words seen once."""
    width = CLASSES + 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            if len(batch):
                raw, _ = sequences(batch.column("classes"))
                of, once = (raw % ONCE).astype(np.int64), raw >= ONCE
                total += np.bincount(of[:-1] * width + of[1:], minlength=len(total))
                total += np.bincount(of[:-1][once[1:]] * width + CLASSES + 1, minlength=len(total))
                total += np.bincount((CLASSES + 1) * width + of[1:][once[:-1]], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = texts.where("not held").select("classes").mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width * width)
    out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(width, width)


def probabilities(counts: np.ndarray, used: np.ndarray) -> np.ndarray:
    """P(class | class before), by Witten-Bell; used: which classes have words."""
    common = (counts.sum(axis=0) + 1) * used
    common = common / common.sum()
    kinds = (counts > 0).sum(axis=1, keepdims=True)
    total = counts.sum(axis=1, keepdims=True) + kinds
    return np.where(total > 0, (counts + kinds * common) / np.maximum(total, 1), common)


class Model(NamedTuple):
    totals: Totals
    chunks: DataFrame
    words: DataFrame  # word, c, class
    tables: list[np.ndarray]


def learn(docs: DataFrame, *, id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> Model:
    chunks = chunked(docs, id, text)
    counted = count_words(chunks)
    texts = chunks.select(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    n, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    first = [r.word for r in counted.orderBy(F.desc("c"), "word").limit(CONTEXTS).collect()]
    near = neighbours(chunks, first).groupBy("word").agg(F.collect_list(F.struct("j", "n")).alias("near"))  # at most two a frequent word
    known = stored(counted.join(near, "word", "left").select("word", "c", (F.pmod(F.xxhash64("word"), F.lit(2)) == 0).alias("half"), "near"))
    tables = cluster(known, first[:CLASSES], rounds) if first else [np.zeros((CLASSES, 2 * (CONTEXTS + 2)))]
    words = assigned(known, tables)
    sizes = np.zeros(CLASSES + 2, np.int64)
    for of, size in words.groupBy("class").agg(F.sum("c")).collect():  # a row a class
        sizes[of] = size
    sizes[END] = texts
    return Model(Totals(int(n) + texts, int(distinct) + (texts > 0), texts, sizes), chunks, words, tables)


def score(docs: DataFrame, *, id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs."""
    model = learn(docs, id=id, text=text, rounds=rounds)
    texts = labelled(model.chunks, model.words, model.totals)
    used = model.totals.classes > 0
    used[CLASSES + 1] = True
    moves = np.log10(np.maximum(probabilities(transitions(texts), used), 1e-300)) if model.totals.texts else np.zeros((CLASSES + 2, CLASSES + 2))
    shared = docs.sparkSession.sparkContext.broadcast(moves)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            raw, first = sequences(batch.column("classes"))
            of = raw % ONCE
            into = table[of[:-1], of[1:]]  # each text's tokens and its end
            sums = np.add.reduceat(into, first[:-1]) if len(batch) else np.zeros(0)
            total = pc.add(batch.column("emission"), pa.array(sums, pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "held", "n_tokens", "n_known", "base")), total], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kind = texts.schema["id"].dataType.simpleString()
    scored = texts.mapInArrow(work, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id), "held_out", "n_tokens", "n_known", F.lit(model.totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
