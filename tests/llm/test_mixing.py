import re

from pyspark.sql import functions as F

from quire.llm.mixing import mix, mixed_documents


def expected_targets(rows, weights=(3, 1, 2), share=1.5, repeats=2):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [x for x in sizes if x is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:  # share what is left by weight; who is above its cap stays there
        total = sum(weight[n] for n in open_)
        over = {n for n in open_ if left * weight[n] / total > repeats * sizes[n]}
        if not over:
            target |= {n: left * weight[n] / total for n in open_}
            break
        target |= {n: float(repeats * sizes[n]) for n in over}
        left -= sum(repeats * sizes[n] for n in over)
        open_ -= over
    return sizes, target


def check(df, near, **options):
    rows = df.collect()
    sizes, target = expected_targets(rows)
    sources = {(r.doc_id, r.text): r.source for r in rows}
    got = mix(df, **options).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    if len({r.doc_id for r in rows}) == len(rows):
        by = {r.doc_id: r.source for r in rows}
        for name in sizes:
            own = [r for r in got if by[r.doc_id] == name]
            assert abs(own[0].target - target[name]) < 1e-6 and own[0].source_size == sizes[name]
            assert abs(sum(r.taken for r in own) - target[name]) <= near * target[name] + 1
    assert abs(sum(r.taken for r in got) - sum(target.values())) <= near * sum(target.values()) + 100
    return got


def test_targets(docs):
    check(docs, 0.02)
    check(docs, 0.02, shard_words=1000, block_words=16)


def test_reruns_agree(docs):
    again = mix(docs.repartition(7, "n_chars"))
    assert sorted(map(tuple, mix(docs).collect())) == sorted(map(tuple, again.collect()))


def test_odd_rows(odd, none):
    check(odd, 0.05)
    assert mix(none).count() == 0 and mixed_documents(none).count() == 0


def test_mixed_documents(docs, odd):
    for df in (docs, odd):
        extra = df.withColumns({"size": F.lit(1), "whole": F.lit("x"), "rank": F.lit(3)})
        out = mixed_documents(extra)
        assert out.columns == extra.columns
        taken = mix(df).agg(F.sum("taken")).first()[0]
        words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in out.collect())
        assert words == taken


def test_seats_by_brute_force(spark):
    import random

    from quire.llm.mixing import apportion

    rng = random.Random(8)
    parties = []
    for group, n in enumerate((1, 7, 60, 60, 200, 5)):
        votes = [rng.choice([0, 5, 5, rng.randint(1, 1000)]) for _ in range(n)]
        caps = [0 if v == 0 else rng.randint(1, 6 + v // 20) for v in votes]
        seats = [min(sum(caps), x) for x in (3, 11, 150, 10**6, 250, 0)][group]
        parties += [(group, i, float(v), c, seats) for i, (v, c) in enumerate(zip(votes, caps, strict=True))]
    df = spark.createDataFrame(parties, "rank int, shard int, votes double, cap long, seats long")
    want = {}
    for g in {p[0] for p in parties}:
        own = [p for p in parties if p[0] == g]
        quotients = sorted((-v / (2 * k + 1), i) for _, i, v, c, _ in own if v for k in range(c))[: own[0][4]]
        want |= {(g, p[1]): sum(1 for _, i in quotients if i == p[1]) for p in own}
    got = {(r.rank, r.shard): r.won for r in apportion(df, "votes", "seats", "cap", "shard", "won").collect()}
    assert got == want


def test_repeated_rows_and_null_identifiers(spark):
    rows = [(None, f"a b c {i % 3}", "s", 7) for i in range(30)] + [(1, "x y z", "s", 5)] * 5 + [(1, "other words here", "t", 16)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = mixed_documents(df, block_words=2, shard_words=20)
    assert sum(len(r.text.split()) for r in out.collect()) == mix(df, block_words=2, shard_words=20).agg(F.sum("taken")).first()[0]
