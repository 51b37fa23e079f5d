"""Rechecks of documents as they change: a stream of documents, and findings kept by document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.matching import first_by


def recheck(changes: DataFrame, check: Callable[[DataFrame], DataFrame], store: str, checkpoint: str, key: tuple[str, ...] = ("book", "doc"), order: str = "version") -> StreamingQuery:
    """Starts a stream that checks the newest version of each changed document of a batch and writes its findings.

    Findings lie in one folder a batch, with the versions that were checked beside them; a batch that is retried
    replaces its folder, so that each counts once. `current` gives what holds now.
    """

    def batch(df: DataFrame, number: int) -> None:
        newest = first_by(df, list(key), [F.col(order).desc()])
        newest.select(*key, order).write.mode("overwrite").parquet(f"{store}/checked/batch={number}")
        check(newest).write.mode("overwrite").parquet(f"{store}/findings/batch={number}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, store: str, key: tuple[str, ...] = ("book", "doc")) -> DataFrame:
    """The findings of each document's newest check."""
    newest = spark.read.option("basePath", f"{store}/checked").parquet(f"{store}/checked/*").groupBy(*key).agg(F.max("batch").alias("batch"))
    return spark.read.option("basePath", f"{store}/findings").parquet(f"{store}/findings/*").join(newest, [*key, "batch"], "left_semi").drop("batch")
