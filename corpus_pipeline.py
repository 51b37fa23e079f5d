"""The corpus pipeline: documents in, packed token sequences out.

Documents without a known language go; of equal texts one row stays, and of near-duplicates (five-word shingles, Jaccard
similarity 0.8 or more: SimHash links first, then all that these leave open) one document; sources are
mixed to their target weights, in whole documents but for the ends of a shard's run; what is left is packed.
Each stage works on all that the one before it kept, and but for the last returns the columns of documents, whatever
else they hold: columns of a stage's own names play no part and stay as they are.

Edge cases: a null or empty text has no known language and goes in the first stage, as does a text of marks or signs alone. If no row has
a language to learn from, the first stage raises an error, since it would reject all; an empty table gives an empty
result. Null identifiers, sources and lengths are allowed: a null identifier loses to any other among copies, a null source is a source of
its own. Repeated rows are copies of one text, of which one stays. A very long document is scored, compared, mixed and packed whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import shared_dir
from quire.llm.exact import exact_dedup
from quire.llm.language import known_language
from quire.llm.mixing import mixed_documents
from quire.llm.nearcopies import drop_near_copies
from quire.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is of a learned language; the rows as they are."""
    return known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows of each text the one with the largest identifier."""
    return exact_dedup(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest identifier; rows that repeat it all stay."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is taken: as it is, or a run of its words, joined by single spaces, with n_chars to fit."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can neither label languages nor hash, encode or pack as the stages do; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
