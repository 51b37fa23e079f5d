import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from quire.llm.catalog import op13_periodic_runs
from quire.llm.periods import find_runs, number_words, runs_of, with_planted_runs

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words, least=24):
    """All (start, length, period) by trying each period at each place."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted(((a, b, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32((str(doc_id) if doc_id is not None else "").encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(words, runs):
    drop = set()
    for a, b, q in runs:
        drop.update(range(a + q, a + b))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{a},{b},{q}\n" for a, b, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_random_texts(letters):
    draw = random.Random(letters)
    texts = []
    for _ in range(150):
        words = []
        while len(words) < draw.randrange(1, 400):
            block = [f"w{draw.randrange(letters)}" for _ in range(draw.randrange(1, 40))]
            words += block * draw.choice([1, 1, 2, 3, 4, 9])
            if draw.random() < 0.3:
                words += [f"w{draw.randrange(letters)}"] * draw.randrange(60)
        texts.append(words)
    found, packed, ends = number_words(pa.array([" ".join(t) for t in texts]))
    rows = runs_of(found)
    for k, words in enumerate(texts):
        mine = rows[(rows[:, 0] >= found.firsts[k]) & (rows[:, 0] < found.firsts[k + 1])] - [found.firsts[k], 0, 0]
        assert [tuple(r) for r in mine.tolist()] == slow_runs(words), words


def test_blocks_of_long_repeats():
    """Blocks that are periodic themselves, inside runs of longer periods: the progressions."""
    texts = [(["a"] * m + ["b"]) * 5 + ["c"] * 3 + (["a"] * (m - 1) + ["b"]) * 4 for m in range(6, 60)]
    texts += [(["x", "y"] * m + ["z"] * k) * 4 + ["x"] for m in range(1, 30, 3) for k in range(1, 30, 4)]
    texts += [fibonacci(700), fibonacci(90) * 6, (["a"] * 40 + ["b"] * 33) * 3 + ["a"] * 100]
    draw = random.Random(5)
    for _ in range(200):
        block = [w for _ in range(draw.randrange(1, 5)) for w in [draw.choice("ab")] * draw.randrange(1, 30)]
        words = [draw.choice("abc") for _ in range(draw.randrange(9))] + block * draw.randrange(3, 6)
        texts.append(words + block[: draw.randrange(len(block) + 1)] + [draw.choice("abc") for _ in range(draw.randrange(9))])
    found, *_ = number_words(pa.array([" ".join(t) for t in texts]))
    rows = runs_of(found)
    for k, words in enumerate(texts):
        mine = rows[(rows[:, 0] >= found.firsts[k]) & (rows[:, 0] < found.firsts[k + 1])] - [found.firsts[k], 0, 0]
        assert [tuple(r) for r in mine.tolist()] == slow_runs(words), words


def test_query_is_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in op13_periodic_runs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for doc_id, text in rows:
        words = planted(doc_id, WORD.findall(text or ""))
        if len(words) > 2500:
            continue  # brute force tries every period
        runs = slow_runs(words)
        some += bool(runs)
        assert got[doc_id] == expected(words, runs), doc_id
    assert some > 3


def test_odd_rows(odd, none, spark):
    assert find_runs(none).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    odd = odd.withColumnRenamed("source", "n_runs").withColumnRenamed("lang", "start")
    texts = {(r.doc_id, r.text) for r in with_planted_runs(odd).collect()}
    assert {(i, " ".join(WORD.findall(t or ""))) for i, t in texts} == {(i, " ".join(planted(i, WORD.findall(t or "")))) for i, t in rows}
    found = find_runs(odd, with_runs=True, with_text=True).collect()
    assert len(found) == len(rows)
    want = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        want.append((doc_id, *expected(words, slow_runs(words) if len(words) < 2000 else [(0, len(words), 14)])))
    assert sorted((tuple(r)[:8] for r in found), key=str) == sorted(want, key=str)
    long = next(r for r in found if r.doc_id == 6)
    assert long.collapsed.split() == odd.where("doc_id = 1").first().text.split()[:14] and [tuple(r) for r in long.runs] == [(0, 56000, 14)]
    empty = next(r for r in found if r.doc_id == 4)
    assert empty.collapsed == "" and empty.start is None and empty.runs == []


def test_shortest_run(spark):
    docs = spark.createDataFrame([(1, "a b c " * 3), (2, "a b c " * 2)], "doc_id long, text string")
    assert [(r.n_runs, r.period) for r in find_runs(docs, least=9).orderBy("doc_id").collect()] == [(1, 3), (0, None)]
    with pytest.raises(ValueError):
        find_runs(docs, least=2)
    assert len(np.unique([r.runs_sha256 for r in find_runs(docs).collect()])) == 1
