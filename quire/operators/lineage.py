"""Cutting a plan in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; where that is unset, a new local one for a local master, and an error for others."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder, so that later steps neither repeat it nor depend on the executors that made it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, by: Sequence[str] = (), parts: int = 0) -> DataFrame:
    """df as a written table of the shared folder.

    Unlike a checkpoint it has no partitioning of its own, so that a join to it deals out both of its sides anew,
    which is what lets Spark split a key that many rows share.

    With parts it is a table of so many buckets by `by`, and df must lie in as many partitions by these columns: windows, aggregations and
    joins whose keys hold these columns then shuffle nothing, also from one such table to the next. Its joins are merge joins: such tables
    compress so well that by the size of their files Spark would send large ones to all executors, through the driver.
    """
    spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name.replace('_', '-')}"
    if parts:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        df.write.option("path", path).bucketBy(parts, *by).saveAsTable(name)
        return spark.table(name).hint("merge")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
