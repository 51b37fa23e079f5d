"""Language identification of mixed-language text.

A word is a letter and the letters and marks after it, lower-cased; marks without a letter are no word. The script
of its first letter narrows the candidate languages to those that training saw in that script. Its score for a language is the log-likelihood of its byte n-grams, hashed to
`FEATURES` places; Viterbi with a penalty for each switch then labels every word of the whole text, all texts of
a batch in step. A document's language is the one with most letters, its score that language's share of them.

Training: the n-grams of all labelled documents (that aren't held out), counted by Spark. A task sums its own counts first. The model
has FEATURES numbers and the scripts for each language, which is what reaches the driver and is broadcast.

Edge cases: a null text, or one without letters, is `und` with score 0, as is everything if no row is labelled.
Null languages never train. Ties go to the language that sorts first. Repeated rows give repeated rows; an empty
table gives an empty result. A very long text is scored whole. Other columns play no part.

`known_language` also asks whether the text is of a learned language at all: enough of its letters must be in words
that are likely for their language, as likely as nearly all of its training texts' words are (`floors`). It learns from
every labelled row, and holds none out. Without a labelled row nothing is known, and it raises an error rather than reject all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import over_texts, small_batches
from quire.llm.ragged import U64, mixed, scan_words, text_bytes

FEATURES = 1 << 16
NGRAMS = (1, 2, 3, 4)
PENALTY = 10.0
#: A script is a language's own if so much of its training words is in it.
SCRIPT_SHARE = 0.001
BATCH_BYTES = 3 << 19
#: A training task passes its counts on once it has those of so many languages.
LANGS_HELD = 32
UNKNOWN = "und"

#: First code points of Unicode ranges, and their scripts.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "other"), (0x0E00, "Thai"), (0x0E80, "other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"),
    (0x3040, "Kana"), (0x3100, "other"), (0x3130, "Hangul"), (0x3190, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"),
    (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han"), (0x30000, "other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
FIRST_POINTS = np.array([p for p, _ in SCRIPTS])
SCRIPT_OF_RANGE = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


class Batch(NamedTuple):
    """The words of some texts, by their distinct ones."""

    firsts: np.ndarray  # of each text, its first word's number
    distinct: np.ndarray  # of each word, its distinct word's number
    letters: np.ndarray  # of each distinct word
    scripts: np.ndarray  # of each distinct word
    grams: np.ndarray  # features of all distinct words, one word after the other
    gram_words: np.ndarray  # the distinct word of each


def read_words(texts: pa.Array) -> Batch:
    lowered = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"^\p{M}+|[^\p{L}\p{M}]+\p{M}*", " ")
    words = scan_words(*text_bytes(lowered), hashed=False)
    n = len(words.starts)
    ends = np.append(words.starts, len(words.packed)).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(words.packed)])
    coded = column.dictionary_encode()
    data = coded.dictionary.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    flat = np.frombuffer(data.buffers()[2], np.uint8) if n else np.zeros(0, np.uint8)
    flat = np.concatenate([np.full(1, 32, np.uint8), flat[: offsets[-1]], np.full(4, 32, np.uint8)]) if n else np.full(5, 32, np.uint8)
    starts = offsets[:-1] + 1  # each word stands between spaces, shared with its neighbours
    lengths = np.diff(offsets) - 1
    letters = pc.count_substring_regex(data.cast(pa.large_string()), r"\p{L}").to_numpy(zero_copy_only=False).astype(np.int64)
    return Batch(words.firsts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), letters, script_of(flat, starts), *ngrams(flat, starts, lengths))


def script_of(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    a, b, c, d = (flat[starts + i].astype(np.int64) for i in range(4))
    b, c, d = b & 63, c & 63, d & 63
    point = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d)))
    return SCRIPT_OF_RANGE[np.searchsorted(FIRST_POINTS, point, "right") - 1]


def ngrams(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = flat == 32
    owner = np.cumsum(space[:-1], dtype=np.int32) - np.int32(1)  # the space before a word counts as the word's
    found, owners = [], []
    end = int(starts[-1] + lengths[-1]) + 1 if len(starts) else 0
    for n in NGRAMS:
        if end < n:
            continue
        size = end - n + 1
        code = np.full(size, n, U64)
        inside = np.ones(size, bool)
        for i in range(n):
            code = code * U64(257) + flat[i : i + size]
            if 0 < i < n - 1:
                inside &= ~space[i : i + size]
        if n == 1:
            inside &= ~space[:size]
        elif n == 2:
            inside &= ~(space[:size] & space[1 : size + 1])
        at = np.flatnonzero(inside)
        found.append((mixed(code[at]) % U64(FEATURES)).astype(np.int32))
        owners.append(owner[at])
    grams, of = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (found, owners))
    del found, owners
    order = np.argsort(of, kind="stable").astype(np.int32)
    return grams[order], of[order]


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # feature, language: log-likelihood less `common`
    common: np.ndarray  # feature: the languages' mean
    spoken: np.ndarray  # script, language
    seen: np.ndarray  # script: whether any language was trained in it


def labelled(docs: DataFrame, id: str, text: str, lang: str, hold_out: bool) -> DataFrame:
    """(lang, text) of the training rows: all that are labelled, and not held out."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull())
    return (rows.where(~held_out("id")) if hold_out else rows).select("lang", "text")


def held_out(id: str):
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", hold_out: bool = True) -> Model:
    def taken(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        while held:
            name, n = held.popitem()
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "feature", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in small_batches(batches, "text", BATCH_BYTES):
            words = read_words(batch.column("text"))
            own = np.repeat(np.arange(len(batch)), np.diff(words.firsts))
            names = np.array(batch.column("lang").to_pylist(), object)
            for name in sorted(set(names)):
                times = np.bincount(words.distinct[(names == name)[own]], minlength=len(words.letters)).astype(float)
                n = np.concatenate([np.bincount(words.grams, times[words.gram_words], FEATURES), np.bincount(words.scripts, times, len(SCRIPT_NAMES))]).astype(np.int64)
                held[name] = held[name] + n if name in held else n
                if len(held) >= LANGS_HELD:
                    yield from taken(held)
        yield from taken(held)

    counted = over_texts(labelled(docs, id, text, lang, hold_out), count, "lang string, feature int, n long")
    table = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((FEATURES + len(SCRIPT_NAMES), len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    if langs:
        counts[table.column("feature").to_numpy(), [place[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    grams, scripts = counts[:FEATURES] + 0.5, counts[FEATURES:]
    weights = np.log(grams / grams.sum(axis=0))
    common = weights.mean(axis=1) if langs else np.zeros(FEATURES)
    spoken = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=0))
    seen = spoken.any(axis=1)
    return Model(langs, np.asfortranarray(weights - common[:, None], np.float32), common.astype(np.float32), spoken | ~seen[:, None], seen)


class Scores(NamedTuple):
    """Of each distinct word, for each language."""

    sums: np.ndarray  # of the weights of its n-grams
    mean: np.ndarray  # log-likelihood of an n-gram


def scores_of(words: Batch, model: Model) -> Scores:
    shape = (len(words.letters), len(model.langs))
    if not len(words.grams):
        return Scores(np.zeros(shape, np.float32), np.zeros(shape, np.float32))
    first = np.searchsorted(words.gram_words, np.arange(shape[0]))
    total = lambda of: np.add.reduceat(of[words.grams], first)
    sums = np.stack([total(model.weights[:, i]) for i in range(shape[1])], axis=1)
    counts = np.diff(np.append(first, len(words.grams))).astype(np.float32)
    return Scores(sums, (sums + total(model.common)[:, None]) / counts[:, None])


def allowed(sums: np.ndarray, words: Batch, model: Model) -> np.ndarray:
    """The scores, minus a lot where the script rules a language out."""
    return np.where(model.spoken[words.scripts], sums, np.float32(-1e4))


def viterbi(scores: np.ndarray, distinct: np.ndarray, firsts: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word; all texts in step, the longest first."""
    counts = np.diff(firsts)
    order = np.argsort(-counts, kind="stable")
    begin = firsts[:-1][order]
    active = np.searchsorted(-counts[order], -np.arange(int(counts.max(initial=0))), "left")  # texts with more than t words
    came = np.zeros(len(distinct), np.int16)
    switched = np.zeros((len(distinct), scores.shape[1]), bool)
    best = np.zeros((len(order), scores.shape[1]), np.float32)
    for t, n in enumerate(active):
        rows = begin[:n] + t
        now = best[:n]
        came[rows] = top = now.argmax(axis=1)
        by_switch = np.take_along_axis(now, top[:, None], 1) - np.float32(penalty)
        switched[rows] = by_switch > now
        best[:n] = np.maximum(now, by_switch) + scores[distinct[rows]]
    label = np.zeros(len(distinct), np.int16)
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(len(active) - 1, -1, -1):
        rows = begin[: active[t]] + t
        now = state[: active[t]]
        label[rows] = now
        state[: active[t]] = np.where(switched[rows, now], came[rows], now)
    return label


def labelled_letters(words: Batch, model: Model, sums: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of each text and language, each word's language, its text)"""
    texts = len(words.firsts) - 1
    label = viterbi(allowed(sums, words, model), words.distinct, words.firsts, penalty)
    own = np.repeat(np.arange(texts), np.diff(words.firsts))
    size = len(model.langs)
    letters = np.bincount(own * size + label, words.letters[words.distinct], texts * size).reshape(texts, size)
    return letters, label, own


def identify(docs: DataFrame, model: Model, *, id: str = "doc_id", text: str = "text", penalty: float = PENALTY, with_spans: bool = False) -> DataFrame:
    """(id, held_out, lang_pred, score[, spans]): spans are runs of words (of letters) with one language: (first, last, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            n = len(batch)
            best, share, spans = np.full(n, len(model.langs)), np.zeros(n), [[] for _ in range(n)]
            if model.langs:
                words = read_words(batch.column("text"))
                letters, label, own = labelled_letters(words, model, scores_of(words, model).sums, penalty)
                some = letters.sum(axis=1) > 0
                best[some] = letters[some].argmax(axis=1)
                share[some] = letters[some].max(axis=1) / letters[some].sum(axis=1)
                if with_spans and len(label):
                    edge = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (label[1:] != label[:-1])))
                    for a, b in zip(edge, np.append(edge[1:], len(label)), strict=True):
                        spans[own[a]].append({"first": int(a - words.firsts[own[a]]), "last": int(b - 1 - words.firsts[own[a]]), "lang": model.langs[label[a]]})
            columns = [batch.column("id"), batch.column("held_out"), pa.array(names[best].tolist(), pa.string()), pa.array(share, pa.float64())]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "lang_pred", "score", "spans"][: len(columns)])

    rows = docs.select(F.col(id).alias("id"), held_out(id).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, lang_pred string, score double" + ", spans array<struct<first: int, last: int, lang: string>>" * with_spans
    return over_texts(rows, work, schema).withColumnRenamed("id", id)


#: A word is likely if its likelihood is at most so many deviations under the mean of its language's training words.
DEVIATIONS = 3.0


def floors(docs: DataFrame, model: Model, *, id: str = "doc_id", text: str = "text", lang: str = "lang", hold_out: bool = True) -> np.ndarray:
    """The least likelihood of a likely word of each language, from all words of the training texts; a row a language is gathered."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = {x: i for i, x in enumerate(model.langs)}
        sums = np.zeros((3, len(model.langs)))
        for batch in small_batches(batches, "text", BATCH_BYTES):
            words = read_words(batch.column("text"))
            of = np.array([place.get(x, 0) for x in batch.column("lang").to_pylist()], np.int64)  # a language that the model lacks has no words
            of = np.repeat(of, np.diff(words.firsts))
            each = scores_of(words, model).mean[words.distinct, of].astype(float)
            sums += [np.bincount(of, x, len(model.langs)) for x in (np.ones(len(of)), each, each * each)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(model.langs)), pa.int64()), *map(pa.array, sums)], ["lang", "n", "x", "xx"])

    sums = over_texts(labelled(docs, id, text, lang, hold_out), measure, "lang long, n double, x double, xx double").groupBy("lang").agg(F.sum("n"), F.sum("x"), F.sum("xx"))
    least = np.zeros(len(model.langs))
    for i, n, x, xx in sums.collect():
        least[i] = x / n - DEVIATIONS * max(xx / n - (x / n) ** 2, 0) ** 0.5 if n else 0
    return least


def known_language(docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.4, likely: float = 0.3) -> DataFrame:
    """The rows of docs whose language is known; the others are rejected.

    One learned language has at least the share `least` of the letters, and likely words have at least the share `likely`.
    A word of a script that training never saw isn't likely, nor one whose n-grams are too rare for the language that it goes to.
    The decision goes by text, so rows that share an identifier are told apart.
    An empty table gives an empty result; a table without any labelled row is an error.
    """
    model = train(docs, id=id, text=text, lang=lang, hold_out=False)
    if not model.langs:
        if docs.limit(1).count():
            raise ValueError(f"no row of {lang} is labelled, so that no language is known")
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model, floors(docs, model, id=id, text=text, lang=lang, hold_out=False)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, limits = shared.value
        for batch in small_batches(batches, text, BATCH_BYTES):
            words = read_words(batch.column(text))
            scores = scores_of(words, model)
            letters, label, own = labelled_letters(words, model, scores.sums, PENALTY)
            total = letters.sum(axis=1)
            good = scores.mean >= limits
            good[~model.seen[words.scripts]] = False
            found = np.bincount(own, words.letters[words.distinct] * good[words.distinct, label], len(batch))
            yield batch.filter(pa.array((total > 0) & (letters.max(axis=1) >= least * total) & (found >= likely * total)))

    return over_texts(docs, keep, docs.schema)
