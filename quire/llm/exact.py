"""Exact deduplication by content sort.

Sampled splitters deal rows out by normalised bytes: `repartitionByRange` samples the rows for them. A splitter holds a
text's first 64 characters and its hash, so that what the driver gathers of the sample is bounded whatever the texts'
lengths. Within a range the external sort puts equal texts side by side, the walk over the sorted rows compares each whole
text with its neighbour, and a run of equal ones is a group: its size and the identifier to keep come from the run.

A text that many rows share would fill a range of its own. A sample tells which texts may be so common; there are at most
`SHARE` of them. Their rows have a slice of the identifier in the sort key too, so that splitters may cut through them,
and only their runs, at most SLICES for each, are stitched together, by SHA-256 and length. The sample decides about
the way, not about the result.

Edge cases: a null text counts as empty; empty and very long texts are texts like others. A null identifier
loses to any other; groups of null identifiers keep one row. Of rows that repeat an identifier and a text one
is kept. An empty table gives an empty result. Other columns are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, stored

#: Cuts that the splitters may put into the rows of a common text.
SLICES = 4096
#: A text is common if at least this part, and at least LEAST, of about SAMPLE rows have it.
SHARE = 8192
SAMPLE = 1 << 18
LEAST = 32


def first(keep: str) -> Column:
    """The order in which the row that stays comes first."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    return F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()


def with_body(docs: DataFrame, id: str, text: str, normalise: Callable[[Column], Column] | None, *more: Column) -> DataFrame:
    """(id, body, hash, ...), and common: whether the text may be one of many rows."""
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(id).alias("id"), (normalise(body) if normalise else body).alias("body"), *more).withColumn("hash", F.xxhash64("body"))
    rows = docs.count()
    sampled = source.select("hash").sample(min(1.0, SAMPLE / max(rows, 1)), seed=7)
    common = cut(sampled.groupBy("hash").count().where(F.col("count") >= max(LEAST, min(rows, SAMPLE) / SHARE)).select(F.col("hash").alias("of")))
    marked = source.join(F.broadcast(common), F.col("hash") == F.col("of"), "left")
    return marked.withColumn("common", F.col("of").isNotNull()).drop("of")


def runs(source: DataFrame, keep: str) -> DataFrame:
    """Sorts source by range and adds of each row's run: nth, size and best, the row's place, the run's rows and its first identifier."""
    source = source.withColumns({"lead": F.left("body", F.lit(64)), "slice": F.when(F.col("common"), F.pmod(F.xxhash64("id"), F.lit(SLICES))).otherwise(0)})
    key = ["lead", "hash", "slice"]
    ranged = source.repartitionByRange(*key).sortWithinPartitions(*key, "body", first(keep))
    run = Window.partitionBy(*key, "body").orderBy(first(keep))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ranged.withColumns({"nth": F.row_number().over(run), "size": F.count("*").over(whole), "best": F.first("id").over(whole)})


def exact_groups(docs: DataFrame, *, id: str = "doc_id", text: str = "text", keep: str = "largest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256). keep: "smallest" or "largest" identifier."""
    found = runs(with_body(docs, id, text, normalise), keep)
    rows = stored(found.select("id", "common", "nth", "size", "best", F.sha2("body", 256).alias("text_sha256"), F.octet_length("body").alias("n_bytes")))
    extreme = F.max if keep == "largest" else F.min
    whole = rows.where("common and nth = 1").groupBy("text_sha256", "n_bytes").agg(extreme("best").alias("whole_best"), F.sum("size").alias("whole_size"))
    stitched = rows.where("common").join(F.broadcast(whole), ["text_sha256", "n_bytes"])  # a row for each common text
    stitched = stitched.select("id", "nth", F.col("whole_best").alias("keep_id"), F.col("whole_size").alias("group_size"), "text_sha256")
    every = rows.where("not common").select("id", "nth", F.col("best").alias("keep_id"), F.col("size").alias("group_size"), "text_sha256").unionByName(stitched)
    # equal identifiers share a slice, so that only one of them heads its run
    kept = (F.col("nth") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))
    return every.select(F.col("id").alias(id), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", keep: str = "largest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of docs that `exact_groups` keeps, with all their columns; each text is moved once."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    source = with_body(docs, id, text, normalise, whole)
    single = runs(source.where("not common"), keep).where("nth = 1").select("row.*")
    # of common texts the first rows of the runs, and of these the first
    heads = runs(source.where("common"), keep).where("nth = 1")
    run = Window.partitionBy("hash", "body").orderBy(first(keep))
    return single.unionByName(heads.withColumn("nth", F.row_number().over(run)).where("nth = 1").select("row.*"))
