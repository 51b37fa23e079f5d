import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import language
from quire.llm.language import floors, identify, known_language, read_words, scores_of, train, viterbi


def test_held_out_accuracy(docs):
    got = {r.doc_id: r for r in identify(docs, train(docs)).collect()}
    rows = docs.collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_do_not_enter_predictions(docs):
    model = train(docs)
    a = sorted(map(tuple, identify(docs, model).select("doc_id", "lang_pred", "score").collect()))
    b = sorted(map(tuple, identify(docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x")}), model).select("doc_id", "lang_pred", "score").collect()))
    assert a == b


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    scores = rng.normal(0, 3, (30, 3)).astype(np.float32)
    distinct = rng.integers(0, 30, 17)
    firsts = np.array([0, 6, 6, 13, 17])
    label = viterbi(scores, distinct, firsts, 2.0)

    def value(path, part):
        return sum(float(scores[w, s]) for w, s in zip(part, path, strict=True)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    from itertools import product

    for a, b in zip(firsts, firsts[1:], strict=False):
        if a < b:
            part = distinct[a:b]
            best = max(value(p, part) for p in product(range(3), repeat=b - a))
            assert abs(value(list(label[a:b]), part) - best) < 1e-3


def test_spans_of_mixed_text(spark, docs):
    model = train(docs)
    by = {r.lang: r.text for r in docs.where("n_chars > 500 and lang in ('en', 'de')").collect()}
    text = " ".join(by["en"].split()[:60]) + " " + " ".join(by["de"].split()[:60])
    row = identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, with_spans=True).first()
    assert {s.lang for s in row.spans} >= {"en", "de"}
    assert all(b.first == a.last + 1 and a.lang != b.lang for a, b in zip(row.spans, row.spans[1:], strict=False))


def test_scripts_narrow(spark):
    rows = [(i, "привет мир как дела", "ru") for i in range(20)] + [(i + 20, "hello world how are you", "en") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    new = spark.createDataFrame([(1, "жжж щщщ"), (2, "zzz qqq"), (3, "漢字")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in identify(new, train(df)).collect()}
    assert got[1] == "ru" and got[2] == "en" and got[3] in ("en", "ru")


def test_a_language_needs_a_letter(spark, docs):
    texts = ["\u0301", "ः !", "1 \u0301\u0302 2", "\u0301\u0301 ः", "123 !?", "\u0301a", "1\u0301 e\u0301te", "é", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in identify(df, train(docs)).collect()}
    assert [got[i].lang_pred == "und" and got[i].score == 0 for i in range(len(texts))] == [True] * 5 + [False] * 3 + [True]


def test_score_is_a_share_of_letters(spark):
    rows = [(i, "жук лес дом мир", "ru") for i in range(40)] + [(i + 40, "cat dog sun sea", "en") for i in range(40)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    row = identify(spark.createDataFrame([(1, "жук лес cat dog sun sea cat")], "doc_id long, text string"), model, penalty=0.0).first()
    assert (row.lang_pred, round(row.score, 6)) == ("en", round(15 / 21, 6))


def test_unknown_languages_are_rejected(spark, docs):
    foreign = [
        "漢字 仮名 交じり 文 日本語 の 文章 です", "привет мир как дела сегодня хорошая погода", "zxqj kwvzx qqxz jjwq xkcd vwxz qzjx wqkz zzxq jxqv",
        "wszczęście przyszłość łódź żółć gęślą jaźń chrząszcz brzmi w trzcinie szczebrzeszyn wszyscy mężczyźni źdźbło",
        "köszönöm szépen hogy vagy ma este megyünk együtt vacsorázni gyönyörű magyarország fővárosa",
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
        "watu wote wamezaliwa huru hadhi na haki zao ni sawa wote wamejaliwa akili na dhamiri",
    ]
    more = spark.createDataFrame([(10**6 + i, x, None, "s", len(x)) for i, x in enumerate(foreign)], docs.schema)
    kept = {r.doc_id for r in known_language(docs.union(more)).collect()}
    assert not kept & {10**6 + i for i in range(len(foreign))}
    plain = {r.doc_id for r in identify(docs, train(docs)).where("lang_pred <> 'und' and score >= 0.4").collect()}
    assert kept == plain  # no text of a learned language is too unlikely


def test_all_labelled_rows_count(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} {chr(97 + i // 676 % 26) * 3}", "en" if i % 9 else "fr") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for hold_out in (True, False):
        used = [r for r in rows if not hold_out or zlib.crc32(str(r[0]).encode()) % 4 != 2]
        model = train(df, hold_out=hold_out)
        assert model.langs == ["en", "fr"]
        words = [read_words(pa.array([r[1] for r in used if r[2] == x])) for x in model.langs]
        counts = np.stack([np.bincount(w.grams, np.bincount(w.distinct)[w.gram_words], language.FEATURES) for w in words], axis=1) + 0.5
        assert np.allclose(model.weights + model.common[:, None], np.log(counts / counts.sum(axis=0)), atol=1e-4)
        means = [scores_of(w, model).mean[w.distinct, i].astype(float) for i, w in enumerate(words)]
        assert np.allclose(floors(df, model, hold_out=hold_out), [x.mean() - language.DEVIATIONS * x.std() for x in means])


def test_few_languages_are_held(docs, monkeypatch):
    want = train(docs)
    monkeypatch.setattr(language, "LANGS_HELD", 1)
    assert all(np.array_equal(a, b) for a, b in zip(want, train(docs), strict=True))


def test_known_language_holds_no_row_out(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    df = spark.createDataFrame([(i, "some plain words of a text", "en") for i in held], "doc_id long, text string, lang string")
    assert known_language(df).count() == len(held)


def test_no_labelled_row(odd):
    with pytest.raises(ValueError, match="labelled"):
        known_language(odd.withColumn("lang", F.lit(None).cast("string")))


def test_odd_rows(odd, none):
    extra = odd.withColumns({"id": F.lit("x"), "held_out": F.lit(1), "score": F.lit(None).cast("int")})
    got = identify(extra, train(extra)).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5))
    assert identify(none, train(none)).count() == 0
    assert {r.lang_pred for r in identify(odd, train(none)).collect()} == {"und"}
    kept = known_language(extra)
    assert kept.columns == extra.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 6}
    assert not {3, 4, 5} & {r.doc_id for r in kept.collect()}
    assert known_language(none).count() == 0
