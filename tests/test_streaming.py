from pyspark.sql import functions as F

from quire.sources.markup import shred
from quire.streaming.recheck import current, recheck

ROWS = "book string, doc string, version int, text string"


def no_alt(docs):
    return shred(docs, "book", "doc", "text", soup=True).where("tag = 'img' and not map_contains_key(attrs, 'alt')").select("book", "doc", "path")


def test_recheck(spark, tmp_path):
    source, store, check = (f"file://{tmp_path}/{x}" for x in ("in", "store", "cp"))

    def step(rows):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(source)
        recheck(spark.readStream.schema(ROWS).parquet(source), no_alt, store, check).awaitTermination()
        return sorted((r.book, r.doc, r.path) for r in current(spark, store).collect())

    assert step([("b", "x", 1, "<img>"), ("b", "y", 1, "<img><img>")]) == [("b", "x", "img[1]"), ("b", "y", "img[1]"), ("b", "y", "img[2]")]
    assert step([("b", "y", 2, "<img>"), ("b", "y", 3, "<img alt=''>")]) == [("b", "x", "img[1]")]
    assert step([("c", "x", 1, "<p><img></p>")]) == [("b", "x", "img[1]"), ("c", "x", "p[1]/img[1]")]
    assert spark.read.parquet(f"{store}/checked/*").where(F.col("doc") == "y").count() == 2
