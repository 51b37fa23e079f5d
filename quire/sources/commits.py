"""Tables that change by whole commits: rows are written first, and count from the moment on that a numbered commit names them.

A commit's rows lie in a folder of its own. Its number is a file that is created only where it is absent, so that of several writers each
gets a number of its own, without reading the last one first; a run that fails leaves folders that no commit names, and the
table as it was. Nothing is rewritten in place. Listing commits is the driver's work and grows with their number, not with the rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from typing import NamedTuple
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Commit(NamedTuple):
    number: int
    run: str


def _folder(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """The commits of a table, in order; none of an absent one."""
    where, fs = _folder(spark, path)
    if not fs.exists(where):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(where)]
    return sorted(Commit(int(n[:12]), n[13:]) for n in names if n[:12].isdigit())


def _created(fs, folder, number: int) -> bool:
    """Whether this writer is the one that created the number's claim."""
    name = f"{number:012d}"
    if fs.getUri().getScheme() == "file":  # Hadoop's own local files are looked for and then made, which two writers can do at once
        try:
            os.close(os.open(f"{unquote(urlparse(str(folder.toString())).path)}/.{name}", os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False
    try:
        fs.create(folder.suffix(f"/.{name}"), False).close()
        return True
    except Exception as e:  # noqa: BLE001  stores have their own errors for files that exist
        if fs.exists(folder.suffix(f"/.{name}")):
            return False
        raise e


def commit(spark: SparkSession, path: str, run: str) -> int:
    """Makes the rows of `run` count, after all that counts already; the commit's number. A repeated commit of one run counts once."""
    where, fs = _folder(spark, path)
    fs.mkdirs(where)
    done = commits(spark, path)
    for c in done:
        if c.run == run:
            return c.number
    number = done[-1].number + 1 if done else 1
    while not _created(fs, where, number):
        number += 1
    fs.create(where.suffix(f"/{number:012d}-{run}"), True).close()
    return number


def new_run() -> str:
    return uuid.uuid4().hex


def committed(spark: SparkSession, path: str, part: str, schema: str, upto: int | None = None) -> DataFrame:
    """The rows of a part of the table (a folder name), with `commit`, their commit's number; upto: of the commits up to this one."""
    named = [c for c in commits(spark, path) if upto is None or c.number <= upto]
    numbers = spark.createDataFrame([(c.run, c.number) for c in named], "run string, commit long")
    if not named:
        return spark.createDataFrame([], schema).withColumn("commit", F.lit(None).cast("long"))
    rows = spark.read.schema(f"{schema}, run string").parquet(*[f"{path}/{part}/{c.run}" for c in named])
    return rows.join(F.broadcast(numbers), "run").drop("run")


def write_part(rows: DataFrame, path: str, part: str, run: str) -> None:
    rows.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{path}/{part}/{run}")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def replace_keys(path: str, new: DataFrame, key: Sequence[str], scope: DataFrame | None = None, run: str | None = None) -> int:
    """Replaces all rows of the keys in scope (of new, by default) by new's; the commit's number.

    A key in scope without new rows is empty then; rows of new outside scope are an error. The same run written again is one commit.
    """
    spark, run = new.sparkSession, run or new_run()
    keys = (new if scope is None else scope).select(*key).distinct()
    write_part(keys, path, "scope", run)
    write_part(new, path, "rows", run)
    if scope is not None:
        written = spark.read.parquet(f"{path}/rows/{run}")
        same = [written[k].eqNullSafe(keys[k]) for k in key]
        if written.join(keys, same, "left_anti").limit(1).count():
            raise ValueError("rows outside the keys that are replaced")
    return commit(spark, path, run)


def current_rows(spark: SparkSession, path: str, key: Sequence[str], schema: str, upto: int | None = None) -> DataFrame:
    """The rows that hold: of each key those of the last commit that replaced it. schema: the rows' columns, key among them."""
    kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
    scope = committed(spark, path, "scope", ", ".join(f"`{k}` {kinds[k]}" for k in key), upto)
    newest = scope.groupBy(*key).agg(F.max("commit").alias("commit"))
    rows = committed(spark, path, "rows", schema, upto).alias("r")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*key, "commit")]
    return rows.join(newest.alias("s"), same, "left_semi").drop("commit")
