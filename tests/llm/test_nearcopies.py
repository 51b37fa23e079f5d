import random

import corpus_pipeline
from pyspark.sql import functions as F

from quire.llm.exact import exact_dedup
from quire.llm.nearcopies import drop_near_copies

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(texts):
    """texts: {id: text} -> the smallest identifier of each component"""
    sets, root = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(texts)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(n) for n in nodes}


def variants(n, seed):
    """Clusters of texts with some words replaced, a shared passage, short texts and ones that differ in case only."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = rng.choices(vocabulary, k=30)
    out = []
    while len(out) < n:
        base = rng.choices(vocabulary, k=rng.choice([3, 6, 9, 12, 40, 120, 300])) + passage * rng.choice([0, 1])
        for _ in range(rng.choice([1, 2, 12])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
            out.append(text.upper() if rng.random() < 0.1 else text)
    return dict(enumerate(out))


def test_stage_finds_every_similar_pair(spark, docs):
    once = exact_dedup(docs, keep="largest").where("text is not null")
    texts = {r.doc_id: r.text for r in once.collect()}
    expected = brute(texts)
    assert len(expected) < len(texts)
    out = corpus_pipeline.near_copies(spark, once, SF)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(expected)


def test_no_pair_is_lost(spark):
    texts = variants(700, 5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_copies(df).collect()) == sorted(brute(texts))


def test_a_split_group(spark, monkeypatch):
    import quire.llm.nearcopies as nearcopies

    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(60)]
    texts = {}
    for i in range(240):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(3000)}"
        texts[i] = " ".join(words)
    monkeypatch.setattr(nearcopies, "RUN", 30)  # keys of some 200 texts become cells of two blocks each
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute(texts)
    assert 1 < len(expected) < 240
    assert sorted(r.doc_id for r in drop_near_copies(df).collect()) == sorted(expected)


def test_pairs_of_keys_by_brute_force(monkeypatch):
    import numpy as np
    import pyarrow as pa

    import quire.llm.nearcopies as nearcopies

    monkeypatch.setattr(nearcopies, "SMALL", 4)
    monkeypatch.setattr(nearcopies, "BLOCK", 3)
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 12, 90))
    n, label = rng.integers(90, 110, 90), rng.integers(0, 5, 90)
    bits = rng.random((90, nearcopies.BITS)) < 0.012
    names = ["key", "cell", "block", "whole", "ref", "label", "n", "place", "bits"]
    table = pa.table([pa.array(x) for x in (key, key * 0, key * 0, key == key, np.arange(90), label, n, n * 0)] + [pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())], names)
    may = {(i, j) for i in range(90) for j in range(i + 1, 90) if key[i] == key[j] and label[i] != label[j] and 9 * (bits[i] ^ bits[j]).sum() <= n[i] + n[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j])}
    for size in (7, 90):
        every, nearest = ({(u, v) for b in nearcopies.pairs_of_keys(iter(table.to_batches(size)), e) for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)} for e in (True, False))
        assert every == may and len(may) > 20
        assert nearest <= may and {x for p in nearest for x in p} == {x for p in may for x in p}


def test_odd_rows(odd, none):
    extra = odd.withColumns({"node": F.lit("x"), "component": F.lit(1), "key": F.lit(None).cast("int")})
    got = drop_near_copies(extra)
    assert got.columns == extra.columns
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    assert ids == [1, 3, 7, 7]
    assert drop_near_copies(none).count() == 0
