"""Pieces that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators.lineage import cut, shared_dir, stored  # noqa: F401

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def id_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("null"))


def partitions_for(rows: DataFrame, wanted: int) -> int:
    """A number of partitions that grows with the data: `wanted`, but no less than the session's own."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)


#: Rows of texts that go to a Python worker at once, at most; Spark's own default, 10,000, is for short rows.
TEXT_ROWS = 2000


def over_texts(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """rows.mapInArrow(work, schema), with batches that suit texts: it lowers the session's setting of rows in an Arrow batch."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", rows.sparkSession.conf
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
    return rows.mapInArrow(work, schema)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the text of each is at most `most` bytes, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
