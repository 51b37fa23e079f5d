import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from quire.llm.exact import exact_dedup, exact_groups


def brute(rows, largest=True):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for r in rows:
        ids = [x for x in groups[r.text or ""] if x is not None]
        keep = (max if largest else min)(ids) if ids else None
        out.append((r.doc_id, keep, len(groups[r.text or ""]), hashlib.sha256((r.text or "").encode()).hexdigest()))
    return out


key = lambda rows: sorted(map(repr, rows))


def test_groups(docs):
    got = exact_groups(docs).collect()
    assert key((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == key(brute(docs.collect()))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_odd_rows(odd, none):
    for keep in ("largest", "smallest"):
        got = exact_groups(odd, keep=keep).collect()
        assert key((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == key(brute(odd.collect(), keep == "largest"))
        kept = [r.text_sha256 for r in got if r.kept]
        assert sorted(kept) == sorted({r.text_sha256 for r in got})
    assert exact_groups(none).count() == 0


def test_dedup_keeps_whole_rows(odd):
    extra = odd.withColumns({"id": F.lit(1), "keep_id": F.lit("x"), "slice": F.lit(None).cast("int"), "a.b": F.lit(2)})
    got = exact_dedup(extra)
    assert got.columns == extra.columns
    assert sorted(x.text or "" for x in got.collect()) == sorted({x.text or "" for x in odd.collect()})


def test_normalised(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a B")], "doc_id long, text string")
    assert [r.doc_id for r in exact_dedup(df, normalise=F.lower, keep="smallest").collect()] == [1]


def test_common_texts_are_stitched(spark):
    rows = [(i, "common" if i % 3 else f"text {i % 40}") for i in range(900)] + [(None, "common")] * 3 + [(5, "common")] * 2 + [(10**6, "common")] * 2 + [(i, None if i % 2 else "") for i in range(2000, 2100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for keep in ("largest", "smallest"):
        got = exact_groups(df, keep=keep).collect()
        assert key((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == key(brute(df.collect(), keep == "largest"))
        kept = sorted((r.text_sha256, r.doc_id) for r in got if r.kept)
        assert kept == sorted({(r.text_sha256, r.keep_id) for r in got})
        once = exact_dedup(df, keep=keep).collect()
        assert sorted((hashlib.sha256((r.text or "").encode()).hexdigest(), r.doc_id) for r in once) == kept


def test_one_shuffle_of_text(docs):
    plan = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 2 and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1  # the last one for heads of common texts alone
