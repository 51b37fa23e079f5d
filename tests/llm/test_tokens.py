import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.tokens import cached, count_tokens, fill_cache, tokenizer_digest

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def brute(rows, path=PIECES, limit=4096):
    if path.endswith(".json"):
        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        t = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(t.encode(x))
    return sorted(((r.doc_id, len((r.text or "").encode()), n := count(r.text or ""), n > limit) for r in rows), key=repr)


run = lambda df, *a, **b: sorted(map(tuple, count_tokens(df, *a, **b).collect()), key=repr)


def test_counts_and_cache(docs, tmp_path, spark):
    cache = f"file://{tmp_path}/cache"
    half = docs.where("doc_id % 2 = 0")
    assert run(half, PIECES, cache) == brute(half.collect())
    distinct = half.select("text").distinct().count()
    assert spark.read.parquet(cache).count() == distinct
    assert run(docs, PIECES, cache) == brute(docs.collect())
    assert spark.read.parquet(cache).count() == docs.select("text").distinct().count()  # hits aren't encoded again
    assert run(docs, PIECES, cache, limit=100) == brute(docs.collect(), limit=100)
    assert spark.read.parquet(cache).count() == docs.select("text").distinct().count()


def test_only_missing_texts_move(docs, tmp_path, spark):
    for few in (0, 10, 1 << 17):
        cache = f"file://{tmp_path}/cache{few}"
        distinct = docs.select("text").distinct().count()
        some = docs.where("doc_id < 50")
        first = fill_cache(some, PIECES, cache, few=few)
        assert first == some.select("text").distinct().count()
        assert fill_cache(docs, PIECES, cache, few=few) == distinct - first and spark.read.parquet(cache).count() == distinct
        assert fill_cache(docs, PIECES, cache, few=few) == 0


def test_a_tokenizer_has_its_own_counts(docs, tmp_path, spark):
    cache = f"file://{tmp_path}/cache"
    few = docs.limit(20)
    assert run(few, PIECES, cache) == brute(few.collect())
    assert run(few, WORDS, cache) == brute(few.collect(), WORDS)
    assert cached(spark, cache, tokenizer_digest(WORDS)).count() == cached(spark, cache, tokenizer_digest(PIECES)).count()


def test_stored_counts_are_used(docs, tmp_path, spark):
    cache = f"file://{tmp_path}/cache"
    few = docs.limit(5)
    spark.createDataFrame([(r.d, tokenizer_digest(PIECES), -7) for r in few.select(F.sha2("text", 256).alias("d")).distinct().collect()], "digest string, tokenizer string, n_tokens long").write.parquet(cache)
    assert {r.n_tokens for r in count_tokens(few, PIECES, cache).collect()} == {-7}


def test_odd_rows(odd, none, tmp_path):
    extra = odd.withColumns({"id": F.lit("x"), "digest": F.lit(1), "n_tokens": F.lit(None).cast("int")})
    assert run(extra, PIECES, f"file://{tmp_path}/a") == brute(odd.collect())
    assert count_tokens(none, PIECES, f"file://{tmp_path}/b").count() == 0
