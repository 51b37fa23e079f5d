import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import classes
from quire.llm.catalog import op11_class_lm
from quire.llm.classes import CLASSES, CONTEXTS, END, Words, classes_of, entropy, gains, labelled, learn, own_gain, probabilities, score, transitions, value

from .conftest import DOCUMENTS, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def expected(rows, of):
    """All columns but the identifier by plain dictionaries, from the classes of words."""
    counts, texts = Counter(), 0
    for i, t in rows:
        if not is_held(i):
            counts.update(tokens(t))
            texts += 1
    n, v = sum(counts.values()) + texts, len(counts) + (texts > 0)
    sizes = Counter()
    for w, c in counts.items():
        sizes[of[w]] += c
    unseen = CLASSES + 1
    classed = lambda t: [END, *(of.get(w, unseen) for w in tokens(t)), END]
    moves = Counter()
    for i, t in rows:
        if not is_held(i):
            c, w = classed(t), [None, *tokens(t), None]
            for a in range(len(c) - 1):
                moves[c[a], c[a + 1]] += 1
                moves[c[a], unseen] += counts.get(w[a + 1], 0) == 1
                moves[unseen, c[a + 1]] += counts.get(w[a], 0) == 1
    used = {*of.values(), unseen, *([END] if texts else [])}
    into = Counter()
    for (_, b), k in moves.items():
        into[b] += k
    common = {b: (into[b] + 1) / sum(into[x] + 1 for x in used) for b in used}

    def p(a, b):
        kinds, total = sum(moves[a, x] > 0 for x in used), sum(moves[a, x] for x in used)
        return (moves[a, b] + kinds * common[b]) / (total + kinds) if total else common[b]

    out = []
    for i, t in rows:
        w, c = tokens(t), classed(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((texts + 1) / (n + v + 1))
        model = sum(math.log10(p(a, b)) for a, b in zip(c, c[1:])) + sum(math.log10(counts[x] / sizes[of[x]]) for x in w if x in counts)
        out.append((i, is_held(i), len(w) + 1, sum(x in counts for x in w) + (texts > 0), n, base, model))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def test_query_is_brute_force(spark, docs):
    got = op11_class_lm(spark, SF).collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    of = {r.word: r["class"] for r in learn(docs).words.collect()}
    same(got, expected(rows, of))
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark, odd, none):
    assert score(none).count() == 0
    clash = odd.withColumnRenamed("lang", "held").withColumnRenamed("source", "word")
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    same(score(clash).collect(), expected(rows, {r.word: r["class"] for r in learn(odd).words.collect()}))
    alone = spark.createDataFrame([(i, "Any Words", "en", "a", 1) for i in range(60) if is_held(i)], DOCUMENTS)  # nothing trains
    assert {tuple(r)[1:] for r in score(alone).collect()} == {(True, 3, 0, 0, 0.0, 0.0)}


def drawn(seed, n=60):
    draw = np.random.default_rng(seed)
    sizes = draw.integers(1, 6, n)
    side = CONTEXTS + 2
    j = np.concatenate([np.sort(draw.choice(2 * side, k, replace=False)) for k in sizes])
    count = draw.integers(1, 5, len(j))
    first = np.cumsum(sizes) - sizes
    # both sides have as many neighbours as the word has tokens
    rows = [dict(zip(j[a : a + k], count[a : a + k], strict=True)) for a, k in zip(first, sizes, strict=True)]
    c = np.array([max(sum(x for q, x in r.items() if q < side), sum(x for q, x in r.items() if q >= side)) for r in rows])
    for r, k in zip(rows, c, strict=True):
        for at, own in ((side - 1, lambda q: q < side), (2 * side - 1, lambda q: q >= side)):
            r[at] = r.get(at, 0) + k - sum(x for q, x in r.items() if own(q))
    sizes = np.array([len(r) for r in rows])
    flat = [(q, x) for r in rows for q, x in sorted(r.items())]
    return Words(c, draw.random(n) < 0.5, np.cumsum(sizes) - sizes, np.array([q for q, _ in flat]), np.array([x for _, x in flat]))


def table_of(words, of):
    table = np.zeros((CLASSES, 2 * (CONTEXTS + 2)))
    np.add.at(table, (np.repeat(of, np.diff(np.append(words.firsts, len(words.j)))), words.j), words.n)
    return table


@pytest.mark.parametrize("seed", range(3))
def test_gains_are_differences_of_the_value(seed):
    words = drawn(seed)
    of = np.random.default_rng(seed).integers(0, 5, len(words.c))
    table = table_of(words, of)
    gain, own = gains(words, table), own_gain(words, table, of)
    for w in range(0, len(of), 7):
        without = table.copy()
        a, b = words.firsts[w], np.append(words.firsts, len(words.j))[w + 1]
        without[of[w], words.j[a:b]] -= words.n[a:b]
        assert own[w] == pytest.approx(value(table) - value(without), abs=1e-6)
        for k in range(6):
            if k != of[w]:
                more = table.copy()
                more[k, words.j[a:b]] += words.n[a:b]
                assert gain[w, k] == pytest.approx(value(more) - value(table), abs=1e-6)


def test_rounds_raise_the_value():
    words = drawn(9, 400)
    start = np.zeros((CLASSES, 2 * (CONTEXTS + 2)))
    start[:8] = table_of(words, np.arange(400) % 8)[:8]
    tables, values = [start], []
    for _ in range(6):
        tables.append(table_of(words, classes_of(words, tables)))
        values.append(value(tables[-1]))
    assert max(values[1:]) > values[0]
    assert entropy(np.array([0.0, 1.0, 2.0])).tolist() == [0, 0, 2 * math.log(2)]


def test_words_between_the_same_neighbours_are_worked_out_once(monkeypatch):
    draw = np.random.default_rng(5)
    side, n = CONTEXTS + 2, 500
    rare = np.stack([draw.integers(0, 4, n), side + draw.integers(0, 4, n)], axis=1).ravel()
    more = drawn(5, 40)
    words = Words(np.append(np.ones(n, int), more.c), np.append(draw.random(n) < 0.5, more.half), np.append(np.arange(n) * 2, 2 * n + more.firsts), np.append(rare, more.j), np.append(np.ones(2 * n, int), more.n))
    tables = [table_of(words, draw.integers(0, 9, n + 40)) for _ in range(4)]
    want = []
    for w, (a, b) in enumerate(zip(words.firsts, np.append(words.firsts, len(words.j))[1:], strict=False)):
        want.append(int(classes_of(Words(words.c[w : w + 1], words.half[w : w + 1], np.zeros(1, int), words.j[a:b], words.n[a:b]), tables)[0]))
    sizes = []
    monkeypatch.setattr(classes, "gains", lambda some, table: sizes.append(len(some.c)) or gains(some, table))
    assert classes_of(words, tables).tolist() == want
    assert max(sizes) <= 4 * 4 * 2 + 40


def test_probabilities_sum_to_one(docs):
    model = learn(docs, rounds=2)
    used = model.totals.classes > 0
    used[CLASSES + 1] = True
    p = probabilities(transitions(labelled(model.chunks, model.words, model.totals)), used)
    assert np.allclose(p.sum(axis=1), 1) and (p[:, used] > 0).all()
    sizes = Counter()
    for r in model.words.collect():
        sizes[r["class"]] += r.c
    assert all(model.totals.classes[k] == n for k, n in sizes.items()) and sum(sizes.values()) + model.totals.texts == model.totals.tokens


def test_classes_tell_languages_apart(spark):
    draw = random.Random(4)
    speech = [[f"{x}{k}" for k in range(30)] for x in "abc"]
    rows = [(i, " ".join(draw.choice(speech[i % 3]) for _ in range(40)), "en", "a", 1) for i in range(240)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = score(docs).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * sum(r.n_tokens for r in held)


def test_small_chunks_give_the_same(spark, docs, monkeypatch):
    want = sorted(tuple(r) for r in score(docs.limit(60), rounds=1).collect())
    monkeypatch.setattr(classes, "CHUNK_BYTES", 3000)
    got = sorted(tuple(r) for r in score(docs.limit(60).repartition(3), rounds=1).collect())
    assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5:] for r in got], [r[5:] for r in want])
