"""Publication packages as tables: one row per entry, and the packages written back."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "book string, name string, content binary, ord int, error string"


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(book, name, content, ord, error) of all packages that path names, from any store that Spark reads.

    A book is named by its file, or, where files of several folders share a name, by the whole path.
    A file that can't be unpacked is one row with an error and no name; it fails nothing else.
    """
    files = spark.read.format("binaryFile").load(path)
    base = F.regexp_replace("path", r"^.*/|\.[eE][pP][uU][bB]$", "")
    twins = files.select(base.alias("base")).groupBy("base").count().where("count > 1").select(F.col("base").alias("twin"))
    named = files.select("path", "content", base.alias("base")).join(twins, F.col("base") == F.col("twin"), "left")
    return unpack(named.select(F.when(F.col("twin").isNull(), F.col("base")).otherwise(F.regexp_replace("path", r"\.[eE][pP][uU][bB]$", "")).alias("book"), "content"))


def unpack(files: DataFrame) -> DataFrame:
    """The entries of packages given as (book, content)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, content in zip(batch.column("book").to_pylist(), batch.column("content"), strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        for i, info in enumerate(x for x in z.infolist() if not x.is_dir()):
                            rows.append((book, info.filename, z.read(info), i, None))
                except Exception as e:  # noqa: BLE001  whatever a damaged file raises is that file's row
                    rows = [(book, None, None, None, f"{type(e).__name__}: {e}")]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int32(), pa.string()), strict=True)], [x.split()[0] for x in ENTRIES.split(", ")])

    return files.select("book", "content").mapInArrow(work, ENTRIES)


def pack_books(entries: DataFrame) -> DataFrame:
    """(book, content): a package for each book, the mimetype entry first and stored as it is."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        pdf = pdf.assign(late=pdf["name"] != "mimetype").sort_values(["late", "ord"])
        with zipfile.ZipFile(out, "w") as z:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                z.writestr(info, content, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"book": [pdf["book"].iloc[0]], "content": [out.getvalue()]})

    return entries.where("name is not null").select("book", "name", "content", "ord").groupBy("book").applyInPandas(build, "book string, content binary")


def write_packages(books: DataFrame, uri: str) -> DataFrame:
    """Writes (book, content) as files under uri, each under its name only when whole; (book, n_bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root)
        for batch in batches:
            for row in batch.to_pylist():
                part = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(row["content"])
                store.move(part, f"{root}/{quote(row['book'], safe=' ')}.epub")
                yield pa.RecordBatch.from_arrays([pa.array([row["book"]]), pa.array([len(row["content"])], pa.int64())], ["book", "n_bytes"])

    return books.mapInArrow(work, "book string, n_bytes long")
