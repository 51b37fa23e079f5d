"""Versions of documents, copy on write: a change stores the documents that it changed, and undoing it reads the older ones.

A store is a table of commits (`sources.commits`): log rows (book, kind, at, summary) and the documents of each change as they are after it.
Changes of a book are numbered by their commits. A row of kind `undo` takes back the newest change before it that isn't undone. What holds is, of
each document, the version of its newest change that isn't undone, so that whatever a change did (deleted, wrapped, put in) is taken back to
equal bytes. A null content says that the document is gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.changes import apply_undo
from quire.sources.commits import commit, committed, new_run, write_part

LOG = "book string, kind string, at timestamp, summary string"
DOCUMENTS = "book string, doc string, digest string, content binary"


def read_log(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(book, kind, at, summary, change, undone): all changes and undos, numbered by `change`."""
    log = committed(spark, path, "log", LOG, upto).withColumnRenamed("commit", "change")
    return apply_undo(log, ["book"], "change", "kind")


def versions(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(book, doc, digest, content, change): every stored version of changes that aren't undone."""
    active = read_log(spark, path, upto).where("kind <> 'undo' and not undone").select("book", "change")
    stored = committed(spark, path, "documents", DOCUMENTS, upto).withColumnRenamed("commit", "change")
    return stored.join(active, ["book", "change"], "left_semi")


def documents(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(book, doc, digest, content, change) as they are now, or were after the commit `upto`. Contents move only where they hold."""
    found = versions(spark, path, upto)
    newest = found.groupBy("book", "doc").agg(F.max("change").alias("change"))
    return found.join(newest, ["book", "doc", "change"], "left_semi").where("content is not null")


def record(path: str, after: DataFrame, kind: str, summary: str = "", gone: DataFrame | None = None, run: str | None = None) -> int | None:
    """Stores one change of the books in after (book, doc, content); the commit's number, or None if no document differs from what holds.

    Documents that are as they were aren't stored, and a book without any other gets no change. gone: (book, doc) that the change takes away.
    """
    spark, run = after.sparkSession, run or new_run()
    if kind == "undo":
        raise ValueError("an undo is no change of documents")
    rows = after.select("book", "doc", F.sha2("content", 256).alias("digest"), "content")
    if gone is not None:
        rows = rows.unionByName(gone.select("book", "doc", F.lit("").alias("digest"), F.lit(None).cast("binary").alias("content")))
    held = documents(spark, path).select("book", "doc", F.col("digest").alias("was"))
    changed = rows.join(held, ["book", "doc"], "left").where("digest <> coalesce(was, '')").drop("was")
    write_part(changed, path, "documents", run)
    books = spark.read.parquet(f"{path}/documents/{run}").select("book").distinct()
    write_part(books.select("book", F.lit(kind).alias("kind"), F.current_timestamp().alias("at"), F.lit(summary).alias("summary")), path, "log", run)
    return commit(spark, path, run) if books.limit(1).count() else None


def undo(path: str, books: DataFrame, run: str | None = None) -> int:
    """Takes back the newest change of each of books (book) that isn't undone; of a book without one nothing."""
    spark, run = books.sparkSession, run or new_run()
    rows = books.select("book").distinct().select("book", F.lit("undo").alias("kind"), F.current_timestamp().alias("at"), F.lit("").alias("summary"))
    write_part(rows, path, "log", run)
    write_part(spark.createDataFrame([], DOCUMENTS), path, "documents", run)
    return commit(spark, path, run)
