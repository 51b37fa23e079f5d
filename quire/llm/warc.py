"""WARC archives, and their normaliser: one gzip member a record, with a sidecar index of offsets.

An archive is a row: its name and its bytes, so that archives lie in whatever store Spark writes to, appear whole or
not at all, and are read back by any executor; `write_files` and `read_files` carry them to and from .warc.gz files.
`archive_pages` writes monolithic archives: one gzip stream over all records. `normalise` inflates each stream once,
from front to back, gives every record a gzip member of its own, and adds the index: where each member lies, and what
it holds; `sidecar` makes that index a table of its own, a row a record. `read_records` goes by the sidecar alone:
its entries meet their archive's bytes by the archive's name, and one member is inflated for each. What the sidecar
doesn't name isn't read. Names of archives are unique.

Of records with equal payloads of `least` bytes or more, that with the smallest identifier is a response, the others
are revisits of it without a payload. Payloads meet by SHA-256 and length; the counts are summed before the shuffle,
and the join to them is one that Spark can split where many records share a payload.

Edge cases: a null payload is empty. A null URL is left out of the header. A null identifier is larger than any other,
and where a group has no other all of it are responses; rows that share the smallest identifier are all responses.
Very long payloads make an archive of their own. An empty table gives no archive and an empty result.
Other columns play no part.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import partitions_for, shared_dir, small_batches, stored

LEAST = 100
ARCHIVE_BYTES = 8 << 20
LEVEL = 4
#: Archives of a task that reads records, so that tasks grow in number, not in size.
TASK_ARCHIVES = 8
DATE = "2000-01-01T00:00:00Z"  # crawl times aren't among the inputs; a fixed one keeps reruns equal
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "array<struct<record_id: string, record_type: string, offset: long, length: long>>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def page_of(name: str | None) -> int | None:
    part = name[len("<urn:page:") : -1] if name else "null"
    return None if part == "null" else int(part)


def record(page: int | None, url: str | None, payload: bytes, digest: str, response: int | None, revisit: bool) -> bytes:
    block = HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~")))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(response))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def read_header(lines: Iterator[bytes]) -> dict[str, str] | None:
    """The fields of the record that begins here, names in lower case; None at the end."""
    line = next(lines, b"")
    while line in (b"\r\n", b"\n"):
        line = next(lines, b"")
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {line[:40]!r}")
    fields: dict[str, str] = {"": line.decode("latin-1").strip()}
    last = ""
    for line in lines:
        if line in (b"\r\n", b"\n"):
            break
        if line[:1] in b" \t" and last:
            fields[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, _, value = line.decode("utf-8", "replace").partition(":")
        last = name.strip().lower()
        fields[last] = value.strip()
    return fields


class Inflated(io.RawIOBase):
    """A gzip stream, of one member or of several, inflated a piece at a time.

    Zero bytes after a member are padding. A stream that ends within a member, its checksum and length included, is an error.
    """

    def __init__(self, data: bytes, step: int = 1 << 16):
        self.data, self.step, self.place = memoryview(data), step, 0
        self.engine, self.ready = zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.ready and self.place < len(self.data):
            part = self.data[self.place : self.place + self.step]
            if self.engine.eof:
                padding = len(part) - len(bytes(part).lstrip(b"\0"))
                if padding:
                    self.place += padding
                    continue
                self.engine = zlib.decompressobj(31)
            self.ready = self.engine.decompress(part)
            self.place += len(part) - len(self.engine.unused_data)
        if not self.ready and not self.engine.eof and len(self.data):
            raise ValueError("the gzip stream ends within a member")
        n = min(len(target), len(self.ready))
        target[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def split_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, the whole record) of each record of an archive, which is inflated once."""
    with io.BufferedReader(Inflated(data), 1 << 16) as stream:
        heard: list[bytes] = []

        def lines() -> Iterator[bytes]:
            while line := stream.readline():
                heard.append(line)
                yield line

        while (fields := read_header(lines())) is not None:
            head = b"".join(heard).lstrip(b"\r\n")
            heard.clear()
            block = stream.read(int(fields["content-length"]))
            if len(block) < int(fields["content-length"]):
                raise ValueError(f"the archive ends within record {fields.get('warc-record-id')}")
            yield fields, head + block + b"\r\n\r\n"


def member(raw: bytes, level: int = LEVEL) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(raw) + engine.flush()


def normalise_archive(data: bytes) -> tuple[bytes, list[dict]]:
    """(the archive with a member for each record, its index)"""
    out, index, place = [], [], 0
    for fields, raw in split_records(data):
        packed = member(raw)
        index.append({"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "offset": place, "length": len(packed)})
        out.append(packed)
        place += len(packed)
    return b"".join(out), index


def revisits(pages: DataFrame, id: str, url: str, payload: str, least: int) -> DataFrame:
    """(page, url, payload, digest, first): first is the smallest identifier of the payload's group, or null for none."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(id).cast("long").alias("page"), F.col(url).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n"))
    narrow = pages.select(F.col(id).cast("long").alias("page"), F.sha2(body, 256).alias("of"), F.octet_length(body).alias("size")).where(F.col("size") >= least)
    firsts = stored(narrow.groupBy("of", "size").agg(F.min("page").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("of", "size", "first"))
    joined = rows.join(firsts, (F.col("digest") == F.col("of")) & (F.col("n") == F.col("size")), "left")
    return joined.select("page", "url", "payload", "digest", "first")


def archive_pages(pages: DataFrame, *, id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, size: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, bytes): monolithic archives of about `size` bytes of records, or one record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in small_batches(batches, "payload", size):
            engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            parts = []
            for row in batch.to_pylist():
                revisit = row["first"] is not None and row["page"] != row["first"]
                parts.append(engine.compress(record(row["page"], row["url"], row["payload"].encode(), row["digest"], row["first"], revisit)))
            parts.append(engine.flush())
            name = f"part-{TaskContext.get().partitionId():05d}-{count:05d}.warc.gz"
            count += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], ["archive", "bytes"])

    return revisits(pages, id, url, payload, least).mapInArrow(write, "archive string, bytes binary")


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, bytes, index): the archives rewritten with a member for each record."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("record_id", pa.string()), ("record_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for row in batch.to_pylist():
                data, index = normalise_archive(row["bytes"])
                yield pa.RecordBatch.from_arrays([pa.array([row["archive"]]), pa.array([data], pa.binary()), pa.array([index], kind)], ["archive", "bytes", "index"])

    return archives.select("archive", "bytes").mapInArrow(work, f"archive string, bytes binary, index {INDEX}")


def sidecar(normalised: DataFrame) -> DataFrame:
    """The index as a table: (archive, record_id, record_type, offset, length)."""
    return normalised.select("archive", F.explode("index").alias("entry")).select("archive", "entry.*")


def read_member(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    fields, whole = next(split_records(raw))
    block = whole[-4 - int(fields["content-length"]) : -4]
    head, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "revisit":
        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return page_of(fields["warc-record-id"]), size, fields["warc-payload-digest"].removeprefix("sha256:"), "revisit", page_of(fields["warc-refers-to"])
    digest = hashlib.sha256(payload).hexdigest()
    if f"sha256:{digest}" != fields["warc-payload-digest"]:
        raise ValueError(f"the payload of {fields['warc-record-id']} isn't the one that was written")
    return page_of(fields["warc-record-id"]), len(payload), digest, "response", None


def read_records(archives: DataFrame, index: DataFrame) -> DataFrame:
    """One row per row of the sidecar index: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for row in batch.to_pylist():
                rows = [read_member(row["bytes"][e["offset"] : e["offset"] + e["length"]]) for e in row["entries"]]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    entries = index.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("entries"))
    dealt = archives.select("archive", "bytes").repartition(partitions_for(archives, archives.count() // TASK_ARCHIVES), "archive")
    return dealt.join(entries, "archive").select("bytes", "entries").mapInArrow(work, RECORDS)


def write_tables(pages: DataFrame, folder: str, **options) -> tuple[str, str, str]:
    """Writes the monolithic archives, the normalised ones and their sidecar index as tables; their paths."""
    spark: SparkSession = pages.sparkSession
    raw, normal, index = (f"{folder}/{x}" for x in ("monolithic", "normalised", "index"))
    archive_pages(pages, **options).write.option("compression", "uncompressed").parquet(raw)
    normalise(spark.read.parquet(raw)).write.option("compression", "uncompressed").parquet(normal)
    sidecar(spark.read.parquet(normal)).write.parquet(index)
    return raw, normal, index


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the pages as archives, normalises these, and reads all records back by the sidecar index."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    _, normal, index = write_tables(pages, folder, **options)
    return read_records(spark.read.parquet(normal), spark.read.parquet(index))


def write_files(archives: DataFrame, uri: str) -> DataFrame:
    """Writes each archive as a file under uri, a store that pyarrow reaches; (archive, n_bytes) of what was written.

    A file gets its name when it is whole, so that a retried task replaces it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root)
        for batch in batches:
            for row in batch.to_pylist():
                part = f"{root}/.{row['archive']}.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(row["bytes"])
                store.move(part, f"{root}/{row['archive']}")
                yield pa.RecordBatch.from_arrays([pa.array([row["archive"]]), pa.array([len(row["bytes"])], pa.int64())], ["archive", "n_bytes"])

    return archives.select("archive", "bytes").mapInArrow(work, "archive string, n_bytes long")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, bytes) of the files at path, from any store that Spark reads."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.col("content").alias("bytes"))
