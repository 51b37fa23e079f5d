import threading

import pytest
from pyspark.sql import functions as F

from quire.operators import versions
from quire.sources import commits
from quire.sources.markup import rewrite_entries

PAGE = "<html><body>\n<table><tr><td>1</td></tr></table><p id='a'>one &amp; two</p><ul><li>x</li><li>y</li></ul></body></html>"
EDITS = {
    "delete": [("html[1]/body[1]/ul[1]/li[1]", "remove", "")],
    "wrap": [("html[1]/body[1]/p[1]", "wrap", "a epub:type=\"noteref\"")],
    "append": [("html[1]/body[1]/ul[1]/li[1]", "append", "<a href=\"#a\">back</a>")],
    "caption": [("html[1]/body[1]/table[1]/tr[1]", "before", "<caption>t</caption>")],
    "marks": [("html[1]/body[1]/a[1]/p[1]", "epub:type", "footnote"), ("html[1]/body[1]/a[1]/p[1]", "role", "doc-footnote")],
    "text": [("html[1]/body[1]/a[1]/p[1]", "text", "new")],
}


def held(spark, path, upto=None):
    return {(r.book, r.doc): bytes(r.content).decode() for r in versions.documents(spark, path, upto).collect()}


def entries(spark, path):
    return versions.documents(spark, path).select("book", F.col("doc").alias("name"), "content")


def test_every_edit_is_undone_to_equal_bytes(spark, tmp_path):
    path = str(tmp_path / "store")
    start = {("b", "1.xhtml"): PAGE, ("b", "2.xhtml"): PAGE + " ", ("c", "1.xhtml"): "<p>other</p>"}
    base = spark.createDataFrame([(*k, bytearray(v.encode())) for k, v in start.items()], "book string, doc string, content binary")
    assert versions.record(path, base, "import") == 1
    assert versions.record(path, base, "import") is None  # nothing differs
    states = [held(spark, path)]
    assert states[0] == start
    for kind, rows in EDITS.items():
        edits = spark.createDataFrame([("b", "1.xhtml", *r) for r in rows], "book string, doc string, path string, name string, value string")
        after = rewrite_entries(entries(spark, path), edits).select("book", F.col("name").alias("doc"), "content")
        number = versions.record(path, after, kind, f"did {kind}")
        states.append(held(spark, path))
        assert states[-1] != states[-2] and number == len(states)
    stored = spark.read.parquet(f"{path}/documents/*").groupBy("book", "doc").count().collect()
    assert {(r.book, r.doc): r["count"] for r in stored} == {("b", "1.xhtml"): 7, ("b", "2.xhtml"): 1, ("c", "1.xhtml"): 1}  # copy on write
    just_b = spark.createDataFrame([("b",)], "book string")
    for state in reversed(states[:-1]):
        versions.undo(path, just_b)
        assert held(spark, path) == state
    assert held(spark, path, upto=4) == states[3]  # as it was then
    log = versions.read_log(spark, path).where("book = 'b'").orderBy("change").collect()
    assert [r.kind for r in log] == ["import", *EDITS, *["undo"] * len(EDITS)] and [r.undone for r in log] == [False] + [True] * len(EDITS) + [False] * len(EDITS)


def test_documents_that_go_come_back(spark, tmp_path):
    path = str(tmp_path / "store")
    base = spark.createDataFrame([("b", "1", bytearray(b"x")), ("b", "2", bytearray(b"")), ("é", "1", None)], "book string, doc string, content binary")
    versions.record(path, base.where("content is not null"), "import")
    versions.record(path, base.where("false"), "drop", gone=base.select("book", "doc").where("book = 'b' and doc = '1'"))
    assert held(spark, path) == {("b", "2"): ""}
    versions.undo(path, spark.createDataFrame([("b",), ("nobody",)], "book string"))
    assert held(spark, path) == {("b", "1"): "x", ("b", "2"): ""}
    with pytest.raises(ValueError):
        versions.record(path, base, "undo")
    assert held(spark, str(tmp_path / "absent")) == {}


def rows_now(spark, path):
    return {tuple(r) for r in commits.current_rows(spark, path, ["k"], "k string, v int").collect()}


def test_keys_are_replaced_by_whole_commits(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    assert rows_now(spark, path) == set()
    commits.replace_keys(path, frame([("a", 1), ("a", 2), ("b", 3), (None, 9)]), ["k"])
    commits.replace_keys(path, frame([("b", 4)]), ["k"], scope=frame([("b", 0), (None, 0)]).select("k"))
    assert rows_now(spark, path) == {("a", 1), ("a", 2), ("b", 4)}
    failing = frame([("a", 7)] * 50).repartition(4).withColumn("v", F.when(F.col("v") == 7, F.expr("CAST(raise_error('lost') AS INT)")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        commits.replace_keys(path, failing, ["k"], run="r1")
    assert rows_now(spark, path) == {("a", 1), ("a", 2), ("b", 4)}
    assert commits.replace_keys(path, frame([("a", 8)]), ["k"], run="r1") == 3
    assert commits.replace_keys(path, frame([("a", 8)]), ["k"], run="r1") == 3  # a repeated run counts once
    assert rows_now(spark, path) == {("a", 8), ("b", 4)}
    assert {tuple(r) for r in commits.current_rows(spark, path, ["k"], "k string, v int", upto=1).collect()} == {("a", 1), ("a", 2), ("b", 3), (None, 9)}
    with pytest.raises(ValueError):
        commits.replace_keys(path, frame([("z", 1)]), ["k"], scope=frame([("a", 0)]).select("k"))


def test_two_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "log")
    found = []

    def write(k):
        for i in range(12):
            found.append(commits.commit(spark, path, f"run{k}x{i}"))

    writers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(set(found)) == 48 and len(commits.commits(spark, path)) == 48
