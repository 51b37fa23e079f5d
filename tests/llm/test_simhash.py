import random

import xxhash
from pyspark.sql import functions as F

from quire.llm.simhash import budgets, forest, key_masks, links, near_groups, run_links, signed


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: {node: fingerprint} -> {node: smallest node}"""
    root = {n: n for n in prints}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(prints)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_documents(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: brute_print(r.text) for r in rows}
    expected = brute_components(prints)
    got = near_groups(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == expected


def close_prints(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(8)] + [0, (1 << 64) - 1]
    out = set(centres)
    while len(out) < n:
        x = rng.choice(sorted(out)) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_no_link_is_lost(spark):
    for seed, options in ((1, {}), (2, {"chain": 7}), (3, {"segments": 4, "chain": 2}), (4, {"segments": 16})):
        prints = close_prints(600, seed)
        df = spark.createDataFrame([(signed(p),) for p in prints], "print long")
        found = {(r.u % (1 << 64), r.v % (1 << 64)) for r in links(df, **options).collect()}
        expected = brute_components({p: p for p in prints})
        root = {p: p for p in prints}

        def find(p, root=root):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in found:
            assert expected[a] == expected[b]
            root[max(find(a), find(b))] = min(find(a), find(b))
        assert {p: find(p) for p in prints} == expected


def test_forest_in_blocks():
    import numpy as np

    base = 0x0123456789ABCDEF
    prints = np.array(sorted({base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(40)} | {base}), np.uint64)
    got = forest(prints, 0, 1, 64, block=7)  # one segment and 64 bits: all link
    assert len(got) == len(prints) - 1 and {b for _, b in got} == {int(prints[0])}
    assert budgets() == [0, 0, 1, 1, 1, 2, 2, 3] and len(key_masks()) == 24


def test_long_runs_are_split():
    import numpy as np

    rng = random.Random(12)
    start, mask = next((s, m) for s, m in key_masks() if s == 2)
    free = [b for b in range(64) if not mask >> b & 1]
    key = rng.getrandbits(64) & mask
    prints = set()
    while len(prints) < 1500:
        x = rng.choice(sorted(prints)) if prints and rng.random() < 0.5 else key | sum(rng.getrandbits(1) << b for b in free)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.choice(free)
        prints.add(x)
    prints = np.array(sorted(prints), np.uint64)
    of = lambda found: brute_roots({int(p) for p in prints}, found)
    whole = of(run_links(prints, start, free, 8, 3, limit=10**6))
    assert of(run_links(prints, start, free, 8, 3, limit=16)) == whole == of(run_links(prints, start, free, 8, 3, limit=200))
    assert 1 < len(set(whole.values())) < 1500


def brute_roots(nodes, found):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in found:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_runs_across_batches():
    import numpy as np
    import pyarrow as pa

    from quire.llm.simhash import links_of_runs

    masks = key_masks()
    prints = np.array(close_prints(300, 7), np.uint64)
    rows = sorted({(w, int(np.uint64(p) & np.uint64(m)), int(p)) for w, (_, m) in enumerate(masks) for p in prints.tolist()})
    arrays = [np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.uint64).view(np.int64), np.array([r[2] for r in rows], np.uint64).view(np.int64)]
    table = pa.table([pa.array(x) for x in arrays], ["way", "key", "print"])
    results = []
    for size in (1, 5, 64, len(rows)):
        out = list(links_of_runs(iter(table.to_batches(size)), masks, 8, 3))
        found = {(u % (1 << 64), v % (1 << 64)) for b in out for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)}
        results.append(brute_roots({int(p) for p in prints}, found))
    assert all(r == results[0] for r in results) and results[0] == brute_components({int(p): int(p) for p in prints})


def test_odd_rows(odd, none):
    extra = odd.withColumns({"id": F.lit("x"), "print": F.lit(1), "component": F.lit(None).cast("int")})
    rows = odd.collect()
    got = near_groups(extra).collect()
    assert sorted(r.fingerprint for r in got) == sorted(f"{brute_print(r.text):016x}" for r in rows)
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and by[5].component_id == 3 and by[4].fingerprint == "0" * 16
    assert near_groups(none).count() == 0
