import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import substring
from quire.llm.substring import leaders, remove_repeats


def brute(rows, k):
    first = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows]
    rank = lambda r: (r.doc_id is None, r.doc_id or 0)
    for r, w in zip(rows, split, strict=True):
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, rank(r)), rank(r))
    out = []
    for r, w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < rank(r):
                gone |= set(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df, k=13, **options):
    return sorted(map(tuple, remove_repeats(df, with_text=False, k=k, **options).collect()), key=repr)


def test_documents(docs):
    got = run(docs)
    assert got == brute(docs.collect(), 13)
    assert sum(r[2] for r in got) > 0
    assert run(docs.repartition(5), buckets=3, chunk=20_000) == got
    assert run(docs, k=5, m=2) == brute(docs.collect(), 5)


def test_heavy_minimisers(docs):
    expected = brute(docs.collect(), 13)
    assert run(docs, most=0) == expected  # every window goes by its longer minimiser
    assert run(docs, most=3000, buckets=50, chunk=50_000) == expected
    assert run(docs, k=5, m=2, most=3000) == brute(docs.collect(), 5)


@pytest.mark.parametrize("size", [3, 8, 12])
def test_a_common_phrase_is_dealt_out(spark, size):
    """A phrase that many documents have, with other words around it, whose runs are the minimisers of most windows that have them."""
    import random

    import pyarrow as pa

    from quire.llm.ragged import scan_words, sequence_hashes, text_bytes

    width = min(size, 8)
    phrases = [[f"p{i}n{j}" for j in range(size)] for i in range(300)]
    least = lambda p, w: min(sequence_hashes(h := scan_words(*text_bytes(pa.array([" ".join(p)]))).hashes, np.arange(len(h) - w + 1), np.full(len(h) - w + 1, w)))
    phrase = min(phrases, key=lambda p: least(p, width))
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(x for _ in range(12) for x in (*rng.choices(vocabulary, k=9), *phrase)) for _ in range(1500)]
    rows = spark.createDataFrame([(i, 0, 0, t) for i, t in enumerate(texts)], "id long, tag long, tag2 long, text string")
    homes = substring.homes_for(rows, 13, 3, 8, 64, 1 << 20, 20_000)
    assert all(len(x) <= substring.MOST_CLASSES // 8 for x in homes.heavy)
    sizes = {}
    for of, where in (("plain", homes._replace(heavy=(homes.heavy[0] & 0,) * 2)), ("two", homes._replace(heavy=(homes.heavy[0], homes.heavy[1] & 0))), ("dealt", homes)):
        cut = substring.super_kmers(pa.array(texts), 13, 3, 8, where)
        sizes[of] = np.bincount(substring.bucket_of(cut.home, cut.level, where), cut.length)
    assert sizes["plain"].max() > 2 * sizes["plain"].mean() and sizes["dealt"].max() < 100_000 < sizes["plain"].max()
    assert size < 8 or sizes["two"].max() > 2 * sizes["dealt"].max()
    few = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:60])], "doc_id long, text string")
    assert run(few, most=20_000, buckets=16) == brute(few.collect(), 13)


def test_null_identifiers(spark):
    rows = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.concat(F.lit("w"), F.pmod(F.hash("id", i), F.lit(10**6)))), " ").alias("text"))
    first = rows.limit(1).collect()[0].text
    both = rows.union(spark.createDataFrame([(5, first)], "doc_id long, text string"))
    gone = remove_repeats(both).where("n_removed > 0").collect()
    assert [(r.doc_id, r.n_removed, r.kept) for r in gone] == [(None, 14, "")]


def test_odd_rows(odd, none):
    extra = odd.withColumns({"id": F.lit("x"), "tag": F.lit(None).cast("int"), "spans": F.lit(1)})
    assert run(extra) == brute(odd.collect(), 13)
    assert remove_repeats(none).count() == 0
    kept = remove_repeats(odd.where("doc_id = 7")).collect()
    assert sorted(r.kept for r in kept) == ["another", "é ü ß 漢字 \U0001f600 \x00"]


def test_equal_hashes_of_unequal_spans():
    body = np.frombuffer(b"aabbaa", np.uint8)
    got, _ = leaders(np.zeros(3, np.uint64), np.array([5, 4, 3]), body, np.array([0, 2, 4]), np.array([2, 2, 2]))
    assert got.tolist() == [3, 4, 3]


def test_no_whole_bucket_of_a_common_passage(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"a{i} {passage} b{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in remove_repeats(df).collect()}
    assert got[0] == 0 and all(got[i] == 60 for i in range(1, 300))
    assert substring.WINDOW == 13
