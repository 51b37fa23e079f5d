import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from quire.llm.language import identify, train
from quire.llm.mixing import mix

from .test_nearcopies import brute
from .test_packing import ids_of

SF = "/root/testdata/sf0.001"


def key(rows):
    return Counter(map(tuple, rows))


def test_stages_by_brute_force(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_copies", "near_copies", "mix_sources", "pack_sequences"]
    step, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, SF)
        assert name == "pack_sequences" or out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        step = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = step.collect()
    rows = docs.collect()

    known = {r.doc_id for r in identify(docs, train(docs)).where("lang_pred <> 'und' and score >= 0.4").collect()}
    assert key(kept["language_id"]) == key(r for r in rows if r.doc_id in known)

    last = {}
    for r in kept["language_id"]:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert key(kept["exact_copies"]) == key(r for r in kept["language_id"] if last[r.text] == r.doc_id)

    roots = brute({r.doc_id: r.text for r in kept["exact_copies"]})  # five words, a similarity of 0.8 or more
    assert key(kept["near_copies"]) == key(r for r in kept["exact_copies"] if r.doc_id in roots)

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    before = {r.doc_id: r for r in kept["near_copies"]}
    taken = Counter()
    for r in kept["mix_sources"]:
        own, part = words(before[r.doc_id].text), words(r.text)
        assert (r.lang, r.source, r.n_chars) == (before[r.doc_id].lang, before[r.doc_id].source, len(r.text))
        assert r.text == before[r.doc_id].text or " " + " ".join(part) + " " in " " + " ".join(own) + " "
        taken[r.doc_id] += len(part)
    plan = mix(spark.createDataFrame(kept["near_copies"], docs.schema)).collect()
    assert taken == Counter({r.doc_id: r.taken for r in plan if r.taken})

    pieces = kept["pack_sequences"]
    assert sum(p.length for p in pieces) == sum(map(len, ids_of([r.text for r in kept["mix_sources"]])))
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(r.doc_id for r in kept["mix_sources"])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.agg(F.max("length")).first()[0] <= 2048 and out.count() > 0


def run_stages(spark, df):
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        assert name == "pack_sequences" or out.columns == df.columns
        df = spark.createDataFrame(out.collect(), out.schema)
        counts.append(df.count())
    return counts, df


def test_odd_rows(spark, docs, odd, none):
    clashing = {"id": F.lit("x"), "key": F.lit(1), "ref": F.lit(None).cast("int"), "rank": F.lit(2), "component": F.lit("c"), "lead": F.lit(3), "hash": F.lit(4), "whole": F.lit(5)}
    counts, pieces = run_stages(spark, odd.union(docs.limit(40)).withColumns(clashing))
    assert all(counts) and pieces.agg(F.max("length")).first()[0] <= 2048
    counts, _ = run_stages(spark, none.withColumns(clashing))
    assert counts == [0] * 5


def test_odd_rows_stage_by_stage(spark, odd):
    """Rows that the first stage rejects are no trouble to the later ones."""
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, odd, SF)
        assert out.count() > 0 and (name == "pack_sequences" or out.columns == odd.columns)
    assert {r.doc_id for r in corpus_pipeline.exact_copies(spark, odd, SF).collect()} == {2, 4, 5, 6, 7}
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, odd, SF).collect()} == {1, 3, 7}
