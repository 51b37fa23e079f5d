"""The operators as queries over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import audio, conversations, licences, warc
from quire.llm.classes import score
from quire.llm.common import shared_dir
from quire.llm.exact import exact_groups
from quire.llm.language import identify, train
from quire.llm.mixing import BLOCK_WORDS, REPEATS, SEED, SHARD_WORDS, SHARE, mix
from quire.llm.packing import pack
from quire.llm.periods import find_runs, with_planted_runs
from quire.llm.simhash import near_groups
from quire.llm.substring import remove_repeats
from quire.llm.tokens import count_tokens


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), shingle=3, seed=42, most=3)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), keep="largest")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False).withColumnRenamed("kept", "kept_sha256")


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = audio.store(documents(spark, sf_dir))
    return audio.probe(stored)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"  # a cache of this run's own; a job would name a lasting one
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), cache)


def op9_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op11_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(with_planted_runs(documents(spark, sf_dir)))


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), ranked AS (
  SELECT *, [3.0, 1.0, 2.0][rank % 3 + 1]::DOUBLE AS weight FROM (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source)
), steps AS (
  SELECT *, source_size * {REPEATS}.0::DOUBLE AS cap,
    ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(source_size * {REPEATS}) OVER (ORDER BY source_size * {REPEATS} / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (ORDER BY source_size * {REPEATS} / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), targets AS (
  SELECT rank, source, source_size, greatest(1, ceil(source_size / {SHARD_WORDS}.0))::BIGINT AS shards,
    coalesce(least(cap, weight * max(CASE WHEN level * weight <= cap THEN level END) OVER ()), cap) AS target
  FROM steps
), placed AS (
  SELECT doc_id, size, rank, digest, ('0x' || substr(digest, 1, 8))::BIGINT % shards AS shard
  FROM (SELECT *, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM sized) s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), shards AS (
  SELECT *, CASE WHEN words > 0 THEN greatest(1, (2 * words + {BLOCK_WORDS}) // {2 * BLOCK_WORDS}) ELSE 0 END AS blocks
  FROM (SELECT rank, shard, sum(size)::BIGINT AS words FROM placed GROUP BY rank, shard)
), source_blocks AS (
  SELECT rank, sum(blocks)::BIGINT AS source_blocks FROM shards GROUP BY rank
), source_seats AS (
  SELECT rank, count(*) AS seats FROM (
    SELECT rank, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS place
    FROM (SELECT rank, target, unnest(range({REPEATS} * source_blocks::BIGINT)) AS k FROM targets JOIN source_blocks USING (rank) WHERE target > 0)
  ) WHERE place <= (SELECT floor(sum(target) / {BLOCK_WORDS} + 0.5) FROM targets) GROUP BY rank
), source_quota AS (
  SELECT rank, coalesce(seats, 0) AS source_quota FROM source_blocks LEFT JOIN source_seats USING (rank)
), shard_seats AS (
  SELECT rank, shard, count(*) AS seats FROM (
    SELECT rank, shard, source_quota, row_number() OVER (PARTITION BY rank ORDER BY words::DOUBLE / (2 * k + 1) DESC, shard, k) AS place
    FROM (SELECT rank, shard, words, source_quota, unnest(range({REPEATS} * blocks)) AS k FROM shards JOIN source_quota USING (rank) WHERE words > 0)
  ) WHERE place <= source_quota GROUP BY rank, shard
), quotas AS (
  SELECT rank, shard, words, blocks, coalesce(seats, 0) AS quota,
    ('0x' || substr(md5('{SEED}:' || rank || ':' || shard), 1, 8))::BIGINT AS seeded
  FROM shards LEFT JOIN shard_seats USING (rank, shard)
), runs AS (
  SELECT rank, shard, quota // blocks AS whole, (seeded % blocks) * words // blocks AS a,
    CASE WHEN seeded % blocks + quota % blocks <= blocks THEN (seeded % blocks + quota % blocks) * words // blocks ELSE words END AS b,
    CASE WHEN seeded % blocks + quota % blocks > blocks THEN (seeded % blocks + quota % blocks - blocks) * words // blocks ELSE 0 END AS c
  FROM quotas WHERE blocks > 0
), spread AS (
  SELECT doc_id, size, rank, shard, sum(size) OVER (PARTITION BY rank, shard ORDER BY digest, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS z FROM placed
)
SELECT doc_id, size, source_size, target,
  (coalesce(whole * size + greatest(0, least(z, b) - greatest(z - size, a)) + greatest(0, least(z, c) - (z - size)), 0))::BIGINT AS taken
FROM spread LEFT JOIN runs USING (rank, shard) JOIN targets USING (rank)
"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


SUBSTRING_SQL = """
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM split WHERE len(words) >= 13)
), firsts AS (
  SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w
), covered AS (
  SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (w) WHERE first_id < doc_id) GROUP BY doc_id
), left_over AS (
  SELECT doc_id, len(words) AS n_words, len(coalesce(places, [])) AS n_removed,
    list_filter(range(1, len(words) + 1), lambda p: NOT list_contains(coalesce(places, []), p)) AS kept, words FROM split LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(list_transform(kept, lambda p: words[p]), ' ')) AS kept_sha256 FROM left_over
"""


WARC_SQL = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM sized
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM firsts
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_simhash_groups, op3_pack_sequences, op4_exact_dedup, op5_substring_dedup, op6_mpeg_audio, op7_language_id, op8_token_counts, op9_warc_normaliser, op10_licence_scan, op11_class_lm, op12_repair_conversations, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": MIX_SQL, "op4_exact_dedup": EXACT_SQL, "op5_substring_dedup": SUBSTRING_SQL, "op9_warc_normaliser": WARC_SQL, "op10_licence_scan": licences.scan_sql(), "op12_repair_conversations": conversations.REPAIR_SQL}
