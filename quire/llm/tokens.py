"""Token counts through a cache of digests.

Each text's SHA-256 and the digest of the tokenizer (its file, library version and way of use) are looked up in a
stored table of counts, before any text moves: if `FEW` distinct texts or fewer are missing, their digests are broadcast and only
texts of these go on; if none is, none does. Of the misses one text each is encoded: copies go out within a task first, then texts are dealt
by digest, which brings what is left of a group of copies to one task, a row a task of the first step at most. The new
counts are appended to the table in one committed write, and every row gets its count by a join on the digest. A run
that fails leaves the table as it was or with whole counts; counts that two runs append are equal, one is read.

Edge cases: a null text is empty. Empty and very long texts are encoded like others, without truncation. Repeated rows
and null identifiers give a row each. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import over_texts, small_batches, stored

LIMIT = 4096
BATCH_BYTES = 4 << 20
#: Digests that are broadcast, at most.
FEW = 1 << 17
CACHE = "digest string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's file, library version and way of use; another of them is another digest."""
    if path.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library.__name__} {library.__version__} plain".encode()).hexdigest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens of texts: no begin, end or other added token, no truncation or padding."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(path)
        plain.no_truncation()
        plain.no_padding()
        return lambda texts: [len(e.ids) for e in plain.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of the cache for this tokenizer; an absent cache is an empty one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest string, n_tokens long")
    found = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each digest in a task."""
    seen: set[str] = set()
    for batch in batches:
        fresh = []
        for digest in batch.column("digest").to_pylist():
            fresh.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def fill_cache(docs: DataFrame, path: str, cache: str, *, text: str = "text", normalise=None, digests: DataFrame | None = None, few: int = FEW) -> int:
    """Encodes the distinct texts that the cache lacks, and appends their counts; their number. digests: those of docs, if they are at hand."""
    tokenizer = tokenizer_digest(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in small_batches(once(batches), "text", BATCH_BYTES):
            n = count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    body = content(text, normalise)
    wanted = docs.select(F.sha2(body, 256).alias("digest")) if digests is None else digests.select("digest")
    missing = stored(wanted.distinct().join(cached(docs.sparkSession, cache, tokenizer), "digest", "left_anti"))
    count = missing.count()
    if not count:
        return 0
    texts = docs.select(F.sha2(body, 256).alias("digest"), body.alias("text"))
    if count <= few:
        texts = texts.join(F.broadcast(missing), "digest", "left_semi")
    dealt = over_texts(texts, once, "digest string, text string").repartition("digest")
    if count > few:
        dealt = dealt.join(missing, "digest", "left_semi")
    over_texts(dealt, encode, CACHE).write.mode("append").parquet(cache)
    return count


def content(text: str, normalise):
    body = F.coalesce(F.col(text), F.lit(""))
    return normalise(body) if normalise else body


def count_tokens(docs: DataFrame, path: str, cache: str, *, id: str = "doc_id", text: str = "text", limit: int = LIMIT, normalise=None) -> DataFrame:
    """One row per row: (id, n_bytes, n_tokens, over_limit). path: of the tokenizer's file; cache: folder of the stored counts."""
    body = content(text, normalise)
    rows = stored(docs.select(F.col(id).alias("id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("digest")))
    fill_cache(docs, path, cache, text=text, normalise=normalise, digests=rows)
    counted = rows.join(stored(cached(docs.sparkSession, cache, tokenizer_digest(path))), "digest")  # Spark splits a digest of many rows
    return counted.select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
