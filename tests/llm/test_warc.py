import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import warc

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def brute(rows, least=100):
    first = {}
    for r in rows:
        p = (r.html or "").encode()
        if len(p) >= least and r.page_id is not None:
            first[p] = min(first.get(p, r.page_id), r.page_id)
    out = []
    for r in rows:
        p = (r.html or "").encode()
        revisit = p in first and r.page_id != first[p]
        out.append((r.page_id, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(out, key=repr)


run = lambda df, **options: sorted(map(tuple, warc.round_trip(df, **options).collect()), key=repr)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    copies = pages.union(pages.withColumn("page_id", F.col("page_id") + 1000).where("page_id % 2 = 0"))
    assert run(copies) == brute(copies.collect())
    assert run(copies, size=10_000, least=5000) == brute(copies.collect(), 5000)


def test_odd_rows(spark):
    long = "x" * 200_000
    rows = [(1, "http://a/é b\r\nX: y", "a" * 100), (2, None, "a" * 100), (3, "u", "a" * 99), (4, "u", "a" * 99), (5, None, None), (None, None, None), (6, "u", ""),
            (7, "u", long), (8, "u", long), (8, "u", long), (None, "u", long), (9, "u", "WARC/1.1\r\n\r\n\r\n" * 20), (None, "n", "z" * 120), (None, "n", "z" * 120)]
    df = spark.createDataFrame(rows, PAGES).withColumns({"page": F.lit("x"), "digest": F.lit(1), "n": F.lit(None).cast("int")})
    assert run(df, size=500) == brute(df.collect())
    assert warc.round_trip(df.where("false")).count() == 0


def test_tables_and_files(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(3)
    raw, normal, index = warc.write_tables(pages, f"file://{tmp_path}/t", size=20_000)
    before, after = ({r.archive: r.bytes for r in spark.read.parquet(p).collect()} for p in (raw, normal))
    assert before.keys() == after.keys() and len(before) > 3
    for name, data in before.items():
        assert gzip.decompress(data) == gzip.decompress(after[name])
    for e in spark.read.parquet(index).collect():
        part = gzip.decompress(after[e.archive][e.offset : e.offset + e.length])
        assert part.startswith(b"WARC/1.1\r\n") and e.record_id.encode() in part
    written = warc.write_files(spark.read.parquet(raw), f"file://{tmp_path}/files").collect()
    assert {r.archive: r.n_bytes for r in written} == {k: len(v) for k, v in before.items()}
    from_files = warc.normalise(warc.read_files(spark, f"file://{tmp_path}/files/*.warc.gz"))
    again = warc.read_records(from_files, warc.sidecar(from_files))
    sidecar = spark.read.parquet(index)
    whole = sorted(map(tuple, warc.read_records(spark.read.parquet(normal), sidecar).collect()))
    assert sorted(map(tuple, again.collect())) == whole
    some = warc.read_records(spark.read.parquet(normal), sidecar.where("record_id like '%7>'")).collect()
    assert sorted(map(tuple, some)) == [r for r in whole if r[0] % 10 == 7]


def test_streams():
    records = [warc.record(i, "u", b"p" * i * 1000, hashlib.sha256(b"p" * i * 1000).hexdigest(), None, False) for i in range(5)]
    whole = gzip.compress(b"".join(records))
    members = b"".join(gzip.compress(r) for r in records)
    data, index = warc.normalise_archive(whole)
    assert gzip.decompress(data) == b"".join(records) and [e["record_id"] for e in index] == [f"<urn:page:{i}>" for i in range(5)]
    assert warc.normalise_archive(members) == (data, index) and warc.normalise_archive(data) == (data, index)
    folded = records[0].replace(b"WARC-Date: ", b"X-Note: a\r\n b\r\nWARC-Date: ").replace(b"\r\n\r\n\r\n", b"\r\n\r\n\r\n\r\n", 1)
    assert len(list(warc.split_records(gzip.compress(folded + records[1])))) == 2
    with pytest.raises(ValueError, match="ends within"):
        list(warc.split_records(gzip.compress(records[4][:-2000])))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.split_records(gzip.compress(b"junk\r\n")))


def test_truncated_streams():
    records = [warc.record(i, "u", bytes([65 + i]) * 5000, hashlib.sha256(bytes([65 + i]) * 5000).hexdigest(), None, False) for i in range(4)]
    whole, members = gzip.compress(b"".join(records)), [gzip.compress(r) for r in records]
    for data in (whole[:-1], whole[:-8], whole[: len(whole) // 2], b"".join(members[:2]) + members[2][:-8], b"".join(members[:2]) + members[2][:20], b"".join(members)[:-1]):
        with pytest.raises(ValueError, match="ends within"):
            warc.normalise_archive(data)
    engine = zlib.compressobj(4, zlib.DEFLATED, 31)
    flushed = engine.compress(b"".join(records[:2])) + engine.flush(zlib.Z_FULL_FLUSH)  # ends at a record's end, without a trailer
    with pytest.raises(ValueError, match="ends within"):
        warc.normalise_archive(flushed)
    wrong = bytearray(whole)
    wrong[-6] ^= 1
    with pytest.raises(zlib.error):
        warc.normalise_archive(bytes(wrong))
    assert warc.normalise_archive(whole + bytes(700)) == warc.normalise_archive(whole)
    assert warc.normalise_archive(members[0] + bytes(70_000) + members[1]) == warc.normalise_archive(members[0] + members[1])
    assert warc.normalise_archive(b"") == (b"", [])
