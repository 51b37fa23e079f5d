import io
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import changes
from quire.plans import edits, model, notes, views
from quire.plans.checks import AFFECTED, CHECKS, run_checks
from quire.sources import packages
from quire.sources.markup import rewrite_entries, rewrite_text, shred, shred_text

from . import publications


@pytest.fixture(scope="module")
def pub(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    (folder / "trades.epub").write_bytes(publications.package())
    (folder / "copy.epub").write_bytes(publications.package())
    (folder / "broken.epub").write_bytes(b"no package")
    return model.publication(packages.read_packages(spark, f"file://{folder}"))


def rules(pub, *names):
    found = run_checks(pub, list(names)).collect()
    by_book = {b: Counter(r.rule for r in found if r.book == b) for b in ("trades", "copy")}
    assert by_book["trades"] == by_book["copy"]
    return dict(by_book["trades"]), [r for r in found if r.book == "trades"]


def test_package_views(pub):
    bad = pub.entries.where("name is null").collect()
    assert [(r.book, r.error.split(":")[0]) for r in bad] == [("broken", "BadZipFile")]
    spine = {r.pos: r.doc for r in pub.spine.where("book = 'trades'").collect()}
    assert spine == {i: f"text/{n}" for i, n in enumerate(publications.CHAPTERS)}
    toc = pub.toc.where("book = 'trades'").orderBy("pos").collect()
    assert [(r.text, r.doc, r.frag) for r in toc] == [("Loom", "text/two.xhtml", "loom"), ("Harbour", "text/one.xhtml", ""), ("Lists", "text/three.xhtml", "three"), ("Notes", "text/four.xhtml", "")]
    marks = model.landmarks(pub).where("book = 'trades'").collect()
    assert Counter(r.epub_type for r in marks) == {"chapter": 1, "footnotes": 2}


def test_reading_nodes(pub):
    nodes = model.reading_nodes(pub.elements.where("book = 'trades' and doc = 'text/one.xhtml'")).orderBy("order_index").collect()
    assert [n.tag for n in nodes][:6] == ["section", "h1", "p", "img", "p", "img"]
    assert nodes[0].parent_path is None and nodes[1].parent_path == "html[1]/body[1]/section[1]" and nodes[1].level == 1
    assert [n.alt for n in nodes if n.tag == "img"] == [None, ""]


def test_simple_checks(pub):
    got, found = rules(pub, "img_alt", "heading_hierarchy", "lang", "duplicate_id", "broken_anchor")
    assert got == {"IMG.NO_ALT": 1, "HEAD.JUMP": 2, "LANG.MISSING": 1, "ID.DUP": 1, "LINK.NO_FILE": 1, "LINK.NO_FRAGMENT": 1}
    dup = next(r for r in found if r.rule == "ID.DUP")
    assert dup.args == {"id": "tide", "first": "html[1]/body[1]/section[1]/h2[1]"} and dup.path == "html[1]/body[1]/section[1]/p[3]"


def test_toc(pub):
    got, found = rules(pub, "toc")
    assert got == {"TOC.ORDER": 1, "TOC.NO_CHAPTER": 1, "TOC.NO_HEADING": 2}
    assert {r.args["id"] for r in found if r.rule == "TOC.NO_HEADING"} == {"tide", "five"}


def test_tables(pub):
    got, _ = rules(pub, "table_a11y")
    assert got == {"TBL.NO_CAPTION": 1, "TBL.BOLD_TD_HEADER": 1, "TBL.TD_SCOPE": 1, "TBL.COL_SPAN": 1, "TBL.ROW_SPAN": 1, "TBL.REF_OUTSIDE": 1, "TBL.REF_MISSING": 1, "TBL.REF_CYCLE": 1, "TBL.REF_ONLY_TD": 1, "TBL.NO_HEADER": 2}


def test_grid(spark):
    html = "<table><tr><td rowspan='2'>a</td><td colspan='x'>b</td><td>c</td></tr><tr><td colspan='2' rowspan='0'>d</td></tr><tr><td>e</td></tr></table>"
    cells = model.table_cells(shred(spark.createDataFrame([("b", "d", html)], "b string, d string, t string"), "b", "d", "t")).orderBy("cell").collect()
    assert [(c.text, c.row, c.col, c.rowspan, c.colspan) for c in cells] == [("a", 0, 0, 2, 1), ("b", 0, 1, 1, 1), ("c", 0, 2, 1, 1), ("d", 1, 1, 1, 2), ("e", 2, 0, 1, 1)]


def test_lists(pub):
    got, found = rules(pub, "list_a11y")
    assert got == {
        "LST.EMPTY": 1, "LST.NESTED_DIRECT": 1, "LST.BAD_CHILD": 1, "LST.BAD_START": 1, "LST.BAD_VALUE": 1, "LST.VALUE_MISMATCH": 1, "LST.ORDINAL_MISMATCH": 1,
        "LST.SPLIT": 2, "LST.INTERRUPTED": 1, "LST.ORPHAN_LI": 1, "LST.PARA_RUN": 2, "LST.LEVEL_JUMP": 2, "LST.BR_LINES": 1,
    }
    runs = sorted((r.args["suggested"], r.args["items"], r.args["blocks"]) for r in found if r.rule == "LST.PARA_RUN")
    assert runs == [("ol", "3", "1"), ("ul", "3", "0")]


def test_notes(pub):
    got, _ = rules(pub, "note_a11y")
    assert got == {
        "NOTE.REF_UNDECL_LINKED": 1, "NOTE.REF_UNDECL": 2, "NOTE.MIXED_LI": 1, "NOTE.UNDECL": 2, "NOTE.REF_EXTERNAL": 1, "NOTE.TARGET_NOT_NOTE": 1, "NOTE.CROSS_CHAPTER": 1,
        "NOTE.REF_NO_ID": 1, "NOTE.NO_BACKLINK_SHARED": 2, "NOTE.NO_BACKLINK_SINGLE": 1, "NOTE.MULTI_REF": 1, "NOTE.BACKLINK_EXTERNAL": 1, "NOTE.DUP_NUMBER": 1, "NOTE.ORPHAN": 4,
        "NOTE.NESTED": 1, "NOTE.CYCLE": 1,
    }


def test_note_batches_and_listening_order(pub):
    graph = notes.note_graph(pub)
    runs = notes.batches(graph).where("book = 'trades'").collect()
    assert sorted((r.batch, r.number, r.note_type) for r in runs) == [(1, 6, "footnote"), (1, 7, "footnote")]
    lines = notes.listening_order(graph).where("book = 'trades'").orderBy("line").collect()
    assert [r.kind for r in lines[:3]] == ["ref", "note", "back"] and lines[0].text == "[1]"
    assert Counter(r.kind for r in lines)["warn"] > 0 and [r.line for r in lines] == list(range(1, len(lines) + 1))


def test_affected_checks_are_known():
    assert {c for names in AFFECTED.values() for c in names} <= set(CHECKS)


def test_packages_round_trip(spark, pub, tmp_path):
    entries = pub.entries.where("book = 'trades'")
    books = packages.pack_books(entries)
    content = books.first().content
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert {n: z.read(n) for n in z.namelist()} == publications.files()
    packages.write_packages(books, f"file://{tmp_path}/out").collect()
    again = model.publication(packages.read_packages(spark, f"file://{tmp_path}/out"))
    before = Counter((r.rule, r.doc, r.path) for r in run_checks(pub).where("book = 'trades'").collect())
    assert Counter((r.rule, r.doc, r.path) for r in run_checks(again).collect()) == before


def test_edits_mend_findings(spark, pub):
    edits = spark.createDataFrame([
        ("trades", "text/one.xhtml", "html[1]/body[1]/section[1]/p[1]/img[1]", "alt", "a pier"), ("trades", "text/two.xhtml", "html[1]", "lang", "en"),
        ("trades", "text/one.xhtml", "html[1]/body[1]/section[1]/h4[1]", "heading_level", "3"), ("trades", "text/one.xhtml", "html[9]", "alt", "x"), ("trades", "text/one.xhtml", "html[1]", "colour", "x"),
    ], "book string, doc string, path string, name string, value string")
    elements, bad = changes.set_attributes(pub.elements, edits)
    assert sorted(r.reason for r in bad.collect()) == ["attribute", "element"]
    after = run_checks(pub._replace(elements=elements), ["img_alt", "heading_hierarchy", "lang"])
    assert Counter((r.book, r.rule) for r in after.collect()) == {("copy", "IMG.NO_ALT"): 1, ("copy", "HEAD.JUMP"): 2, ("copy", "LANG.MISSING"): 1, ("trades", "HEAD.JUMP"): 1}


def test_shredder_odd_markup(spark):
    assert shred_text("", True) == []
    rows = shred_text("<p>a<p>b<br>c<script>x<p></script></div><li>d</p>", True)
    assert [r["tag"] for r in rows] == ["p", "p", "br", "script", "li"] and rows[1]["text"] == "b c d"
    deep = shred_text("<div>" * 500 + "x", False)
    assert deep[0]["last"] == 499 and deep[499]["depth"] == 499
    df = spark.createDataFrame([("b", "n", None), ("b", "e", b""), ("b", "x", b"\xff<p>\xfe</p>")], "b string, d string, t binary")
    assert [(r.doc, r.tag) for r in shred(df, "b", "d", "t").collect()] == [("x", "p")]
    assert shred(df.where(F.lit(False)), "b", "d", "t").count() == 0


def test_views(pub):
    books = views.books(pub).where("book = 'trades'").first()
    assert (books.title, books.language) == ("Small Trades", None)
    names = {r.order_index: r.title for r in views.chapters(pub).where("book = 'trades'").collect()}
    assert names == {0: "Harbour", 1: "Loom", 2: "Lists", 3: "Notes", 4: "Afar"}
    assert set(views.state(pub, run_checks(pub, ["lang"]))) == {"books", "chapters", "nodes", "landmarks", "toc", "issues"}
    nav = views.landmarks_nav(pub)
    assert nav.count() == 0  # no landmark has an id here
    marked = pub._replace(elements=pub.elements.withColumn("attrs", F.when(F.col("tag") == "section", F.map_concat("attrs", F.create_map(F.lit("id"), F.lit("s")))).otherwise(F.col("attrs"))))
    html = views.landmarks_nav(marked).where("book = 'trades'").first().html
    assert html.count("<li>") == 3 and 'href="one.xhtml#s"' in html


def test_table_model_and_inference(pub):
    cells = model.table_cells(pub.elements.where("book = 'trades' and doc = 'text/two.xhtml'")).cache()
    rows = {(r.table_eid, r.row, r.col): r for r in views.table_model(cells).collect()}
    second = sorted({t for t, _, _ in rows})[1]
    assert rows[second, 0, 1].reading == "column header: B" and rows[second, 1, 0].reading == "row header: r"
    assert rows[second, 1, 1].reading == "A: 1" and rows[second, 1, 2].reading == "B, r: 2"
    assert rows[second, 1, 2].covered_by == [1, 2] and 4 in rows[second, 0, 1].covers
    edits, conflicts = views.infer_headers(cells)
    first = sorted({t for t, _, _ in rows})[0]
    assert {(r.row, r.col, r.reason) for r in conflicts.where(F.col("table_eid") != first).collect()} >= set()
    mended, bad = changes.set_attributes(pub.elements.where("book = 'trades'"), edits)
    assert bad.count() == 0
    again = run_checks(pub._replace(elements=mended), ["table_a11y"]).where("book = 'trades'").groupBy("rule").count().collect()
    assert "TBL.BOLD_TD_HEADER" not in {r.rule for r in again}


def test_list_model(pub):
    lists = pub.elements.where("book = 'trades' and doc = 'text/three.xhtml'")
    items = views.list_items(lists).where("list_tag = 'ol' and visible_number is not null").orderBy("eid").collect()
    assert [(r.visible_number, r.ordinal, r.value) for r in items] == [(1, 1, None), (7, 2, None), (8, 9, 9)]
    readings = [r.reading for r in views.list_reading(lists).orderBy("list_eid").collect()]
    assert readings[0].split("\n")[0] == "ordered list, 1 items" and "  1: deep" in readings[0]
    sides = views.list_neighbours(lists).collect()
    assert {r.action for r in sides} >= {"join", "blocked", "extend"}


def test_guards(spark, pub):
    before = pub.elements.where("book = 'trades'")
    assert views.lost_content(before, before).count() == 0
    cut_down = before.withColumn("attrs", F.map_filter("attrs", lambda k, v: k != "id")).where("tag <> 'sup'")
    lost = views.lost_content(before, cut_down).collect()
    assert {r.kind for r in lost} == {"id"} and max(r.lost for r in lost) == 2
    texts = spark.createDataFrame([("b", "d", "a b b")], "book string, doc string, t string")
    assert [(r.item, r.lost) for r in views.lost_characters(texts, texts.withColumn("t", F.lit("b a")), "t").collect()] == [("b", 1)]
    graph = notes.note_graph(pub)
    assert views.note_guard(graph, graph).count() == 0
    edits = spark.createDataFrame([("trades", "text/five.xhtml", "html[1]/body[1]/p[1]/a[1]", "href", "http://x.org")], "book string, doc string, path string, name string, value string")
    edited, _ = changes.set_attributes(pub.elements, edits)
    assert [r.kind for r in views.note_guard(graph, notes.note_graph(pub._replace(elements=edited))).collect()] == ["external"]
    wanted = spark.createDataFrame([("trades", "text/one.xhtml", b) for b in ("tide", "new", "start")], "book string, doc string, base string")
    assert {r.base: r.id for r in views.free_ids(wanted, pub.elements).collect()} == {"tide": "tide-2", "new": "new", "start": "start-2"}


def test_rewritten_markup(spark, pub):
    text = '<?xml version="1.0"?><!DOCTYPE html><p a="1" b=\'2\'>x &amp; &#233;<br/><!-- c --><h2>t</h2><td>v</td></p>'
    assert rewrite_text(text, {}) == text
    assert rewrite_text(text, {"p[1]": {"a": None, "c": '"<'}, "p[1]/h2[1]": {"heading_level": "3"}, "p[1]/td[1]": {"tag": "th", "scope": "col"}}) == (
        '<?xml version="1.0"?><!DOCTYPE html><p b="2" c="&quot;&lt;">x &amp; &#233;<br/><!-- c --><h3>t</h3><th scope="col">v</th></p>'
    )
    edits = spark.createDataFrame([
        ("trades", "text/one.xhtml", "html[1]/body[1]/section[1]/p[1]/img[1]", "alt", "a pier"), ("trades", "text/one.xhtml", "html[1]/body[1]/section[1]/h4[1]", "heading_level", "3"),
    ], "book string, doc string, path string, name string, value string")
    entries = rewrite_entries(pub.entries, edits)
    assert entries.count() == pub.entries.count()
    mended = model.publication(entries.where("name is not null"))
    by_edit, _ = changes.set_attributes(pub.elements, edits)
    want = run_checks(pub._replace(elements=by_edit), ["img_alt", "heading_hierarchy"]).collect()
    assert sorted((r.book, r.rule) for r in run_checks(mended, ["img_alt", "heading_hierarchy"]).collect()) == sorted((r.book, r.rule) for r in want)


def test_structural_rewrites():
    text = '<body><p id="a">one <b>two</b><br/></p><sup>1</sup><aside>note <i>x</i></aside><table><tr><td>v</td></tr></table><img src="i"/></body>'
    edits = {
        "body[1]/p[1]": {"append": "<i>end</i>"}, "body[1]/sup[1]": {"wrap": 'a href="#n"'}, "body[1]/aside[1]": {"remove": ""}, "body[1]/table[1]/tr[1]": {"before": "<caption>c</caption>"}, "body[1]/img[1]": {"alt": "x"},
    }
    assert rewrite_text(text, edits) == '<body><p id="a">one <b>two</b><br/><i>end</i></p><a href="#n"><sup>1</sup></a><table><caption>c</caption><tr><td>v</td></tr></table><img src="i" alt="x"/></body>'
    assert rewrite_text(text, {"body[1]/p[1]": {"text": "a < b"}, "body[1]/img[1]": {"remove": ""}}) == text.replace('one <b>two</b><br/>', "a &lt; b").replace('<img src="i"/>', "")
    assert rewrite_text("<a><b>x<b>y</b></b>z</a>", {"a[1]/b[1]": {"remove": ""}}) == "<a>z</a>"


def test_note_edits(spark, pub):
    graph = notes.note_graph(pub)
    at = {(r.doc, r.el_id, r.path.rsplit("/", 1)[-1]): r for r in graph.refs.where("book = 'trades'").collect()}
    note = {r.el_id or r.path: r.note for r in graph.notes.where("book = 'trades'").collect()}
    ref = {(r.el_id or r.tag + (r.marker or "")): r.ref for r in at.values()}
    asked = spark.createDataFrame([
        ("delete", None, note["n1"], None, None), ("delete", None, note["n9"], None, None), ("mark", None, note["n6"], "footnote", None), ("mark", None, note["n6"], "chapter", None), ("unmark", None, note["own"], "footnote", None),
        ("link", ref["sup[6]"], note["n2"], None, None), ("link", ref["sup[7]"], note["n7"], None, None), ("link", ref["r5"], note["n2"], "http://x.org/#a", None), ("backlink", ref["q1"], note["n1"], None, "go < back"),
        ("unlink", ref["r3"], None, None, None), ("mark", ref["r3"], "trades|text/four.xhtml|9999", "footnote", None), ("frame", None, None, None, None),
    ], edits.ASKED)
    made, refused = edits.note_edits(pub, graph, asked)
    reasons = Counter((r.kind, (r.reason or "").split(" by ")[0]) for r in refused.collect())
    assert reasons == {("delete", "referred to"): 1, ("mark", "type"): 1, ("link", "not declared"): 1, ("link", "external"): 1, ("mark", "nothing there"): 1, ("frame", "kind"): 1}
    entries = rewrite_entries(pub.entries.where("book = 'trades'"), made)
    again = notes.note_graph(model.publication(entries.where("name is not null")))
    after = {r.el_id: r for r in again.notes.collect()}
    assert "n9" not in after and after["n6"].declared and not after["own"].declared
    linked = {r.marker: r for r in again.refs.where("tag = 'a'").collect()}
    assert linked["[6]"].href == "#n2" and linked["[6]"].declared and linked["[6]"].status == "note"
    assert linked["[3]"].href is None
    assert ("go < back",) in [(r.text,) for r in again.backlinks.where("ref is not null").collect()]
    held = edits.incoming_sources(pub, pub.elements.where("book = 'trades' and doc = 'text/four.xhtml' and tag = 'aside'").select("book", "doc", "eid"))
    assert held.where("text = '[1]' and from_doc = 'text/five.xhtml'").count() == 1


def applied(spark, pub, rows, book="trades"):
    """(the note graph after a request, its entries by name, what was refused)"""
    graph = notes.note_graph(pub)
    asked = spark.createDataFrame(rows, edits.ASKED + ", nth int")
    made, refused = edits.note_edits(pub, graph, asked)
    names = [(r.doc, r.path, r.name) for r in made.collect()]
    assert len(names) == len(set(names))  # one edit of a name for each element
    entries = rewrite_entries(pub.entries.where(F.col("book") == book), made)
    texts = {r.name: bytes(r.content).decode() for r in entries.where("name is not null").collect()}
    return notes.note_graph(model.publication(entries.where("name is not null"))), texts, {(r.kind, r.reason) for r in refused.collect()}


def test_stages_of_note_edits(spark, pub):
    """A request's parts see what the parts before them did."""
    graph = notes.note_graph(pub)
    note = {r.el_id or r.path: r.note for r in graph.notes.where("book = 'trades'").collect()}
    ref = {(r.el_id or r.tag + (r.marker or "")): r.ref for r in graph.refs.where("book = 'trades'").collect()}
    # rows stand in any order: links before the marks that make them possible, marks before unmarks
    after, texts, refused = applied(spark, pub, [
        ("link", ref["sup[7]"], note["n7"], None, None, 0), ("mark", None, note["n7"], "endnote", None, 1), ("mark", None, note["n7"], "footnote", None, 2),
        ("link", ref["r3"], note["n2"], None, None, 1), ("link", ref["r3"], note["n6"], None, None, 2), ("unlink", ref["r3"], None, None, None, 0), ("mark", None, note["n6"], "footnote", None, 0),
        ("unmark", None, note["n8"], "footnote", None, 0), ("mark", None, note["n8"], "endnote", None, 0), ("mark", None, note["n9"], "endnote", None, 0), ("unmark", None, note["n9"], "endnote", None, 0),
    ])
    assert not refused
    found = {r.el_id: r for r in after.notes.collect()}
    assert found["n7"].declared and found["n7"].note_type == "footnote" and found["n8"].note_type == "endnote" and found["n8"].declared
    assert not found["n9"].declared if "n9" in found else True
    linked = {r.marker: r for r in after.refs.where("tag = 'a'").collect()}
    assert linked["[7]"].status == "note" and linked["[7]"].href == "#n7" and linked["[3]"].href == "#n6"  # the last link holds
    # judged on what is left: an unmarked note can't be linked, a deleted one is nowhere
    _, _, refused = applied(spark, pub, [
        ("link", ref["sup[6]"], note["n9"], None, None, 0), ("delete", None, note["n9"], None, None, 0), ("link", ref["sup[7]"], note["n2"], None, None, 0), ("unmark", None, note["n2"], "footnote", None, 0),
        ("batch", "trades|text/four.xhtml", None, "99", None, 0), ("mark", None, note["n9"], "footnote", None, 0),
    ])
    assert refused == {("link", "nothing there"), ("link", "not declared"), ("batch", "batch"), ("mark", "nothing there")}


def test_ways_back(spark, pub):
    graph = notes.note_graph(pub)
    note = {r.el_id or r.path: r.note for r in graph.notes.where("book = 'trades'").collect()}
    ref = {(r.el_id or r.tag + (r.marker or "")): r.ref for r in graph.refs.where("book = 'trades'").collect()}
    after, texts, refused = applied(spark, pub, [
        ("unback", ref["r1"], note["n1"], None, None, 0), ("backlink", ref["q1"], note["n1"], None, "q", 0), ("backlink", ref["r5"], note["n1"], None, "r", 1), ("backlink", ref["r4"], note["n2"], None, "x", 0), ("unback", ref["r4"], note["n2"], None, None, 1),
    ])
    assert not refused
    backs = {(r.text, r.ref.rsplit("|", 1)[0]) for r in after.backlinks.where("ref is not null").collect()}
    assert backs == {("q", "trades|text/five.xhtml"), ("r", "trades|text/four.xhtml")}
    assert '<aside epub:type="footnote" id="n1">1. First <p class="note-backlink"><a class="note-backlink" role="doc-backlink" href="five.xhtml#q1">q</a></p><p class="note-backlink"><a class="note-backlink" role="doc-backlink" href="#r5">r</a></p></aside>' in texts["text/four.xhtml"]
    # taken away with its paragraph
    again = model.publication(spark.createDataFrame([("trades", n, bytearray(t.encode()), i, None) for i, (n, t) in enumerate(texts.items())], pub.entries.schema))
    graph = notes.note_graph(again)
    q1, n1 = graph.refs.where("el_id = 'q1'").first().ref, graph.notes.where("el_id = 'n1'").first().note
    _, texts, _ = applied(spark, again, [("unback", q1, n1, None, None, 0)])
    assert '<aside epub:type="footnote" id="n1">1. First <p class="note-backlink"><a class="note-backlink" role="doc-backlink" href="#r5">r</a></p></aside>' in texts["text/four.xhtml"]


def test_batches_and_free_ids(spark):
    """n wants of one base get n ids in order, gaps of the numbers in use first."""
    pairs = "".join(f"<sup>[{k}]</sup>" for k in (1, 2, 3, 4))
    body = f'<p id="fn1-auto">a{pairs}</p><section epub:type="footnotes">' + "".join(f"<div>{k}. note {k}</div>" for k in (1, 2, 3)) + '<aside epub:type="footnote" id="fn1-auto-3">4. four</aside></section><p id="ref-ch1-auto-2"></p><p id="ref-ch1-auto-04"></p>'
    entry = publications.files() | {"text/one.xhtml": publications.page(body).encode()}
    docs = spark.createDataFrame([("trades", n, bytearray(c), i, None) for i, (n, c) in enumerate(entry.items())], "book string, name string, content binary, ord int, error string")
    pub = model.publication(docs)
    graph = notes.note_graph(pub)
    batch = notes.batches(graph).where("doc = 'text/one.xhtml'").collect()
    assert {(r.batch, r.number) for r in batch} == {(batch[0].batch, k) for k in (1, 2, 3, 4)}
    after, texts, refused = applied(spark, pub, [("batch", "trades|text/one.xhtml", None, str(batch[0].batch), None, 0)])
    assert not refused
    found = {r.number: r for r in after.refs.where("doc = 'text/one.xhtml' and tag = 'a'").collect()}
    assert {k: (r.href, r.el_id, r.status) for k, r in found.items()} == {
        1: ("#fn1-auto-2", "ref-ch1-auto", "note"), 2: ("#fn1-auto-4", "ref-ch1-auto-3", "note"), 3: ("#fn1-auto-5", "ref-ch1-auto-4", "note"), 4: ("#fn1-auto-3", "ref-ch1-auto-5", "note"),
    }
    assert all(r.declared for r in after.notes.where("doc = 'text/one.xhtml'").collect())
    assert {r.ref for r in after.backlinks.where("doc = 'text/one.xhtml'").collect()} == {r.ref for r in found.values()}
    wants = spark.createDataFrame([(f"k{i:02}", "b", "d", "x", i) for i in range(12)], "key string, book string, doc string, base string, place int")
    used = spark.createDataFrame([("b", "d", x) for x in ("x-2", "x-3", "x-7", "x-07", "x-q", "xy", "x-12")] + [("b", "e", "x")], "book string, doc string, id string")
    got = [r.id for r in edits.allot_ids(wants, used).orderBy("key").collect()]
    assert got == [f"x-{i}" if i > 1 else "x" for i in (1, 4, 5, 6, 8, 9, 10, 11, 13, 14, 15, 16)]


def test_change_log(spark, pub, tmp_path):
    path = f"file://{tmp_path}/log"
    asked = [("trades", "text/one.xhtml", "html[1]/body[1]/section[1]/p[1]/img[1]", "alt", "a pier"), ("trades", "text/one.xhtml", "html[1]/body[1]/section[1]/h4[1]", "heading_level", "3")]
    rows = spark.createDataFrame(asked, "book string, doc string, path string, name string, value string")
    one = pub.elements.where("book = 'trades'")
    assert edits.read_log(spark, path).count() == 0
    edits.append_change(path, edits.inverse_of(one, rows), "edit", "first")
    changed, _ = changes.set_attributes(one, rows)
    more = rows.withColumn("value", F.lit("2"))
    edits.append_change(path, edits.inverse_of(changed, more), "edit", "second")
    with pytest.raises(ValueError, match="remove"):  # no edits of attributes bring an element back
        edits.inverse_of(changed, rows.withColumn("name", F.lit("remove")))
    log = edits.read_log(spark, path)
    assert [(r.id, r.summary) for r in log.orderBy("id").collect()] == [(1, "first"), (2, "second")] and log.where("at rlike '^\\\\d{4}-\\\\d\\\\d-\\\\d\\\\dT[0-9:]{8}$'").count() == 2
    assert {(r.name, r.value) for r in edits.last_inverse(log).collect()} == {("alt", "a pier"), ("heading_level", "3")}
    undone = log.unionByName(log.where("id = 2").withColumns({"id": F.lit(3).cast("long"), "kind": F.lit("undo")}))
    back, _ = changes.set_attributes(changed, edits.last_inverse(undone))
    assert {(r.name, r.value) for r in edits.last_inverse(undone).collect()} == {("alt", None), ("heading_level", "4")}
    same = lambda df: sorted((r.path, r.tag, tuple(sorted(r.attrs.items()))) for r in df.collect())
    assert same(back) == same(one)


def test_table_edits_and_extent(spark, pub):
    two = pub.elements.where("book = 'trades' and doc = 'text/two.xhtml'")
    cells = model.table_cells(two).cache()
    tables = sorted({r.table_eid for r in cells.collect()})
    extent = {r.table_eid: (r.rows, r.cols) for r in views.grid_extent(cells).collect()}
    assert extent[tables[0]] == (2, 2) and extent[tables[1]] == (3, 3)
    key = ("trades", "text/two.xhtml")
    captions = spark.createDataFrame([(*key, tables[0], "Wool & more"), (*key, tables[1], "Other"), (*key, 9999, "x")], "book string, doc string, table_eid int, caption string")
    changed = spark.createDataFrame([(*key, tables[0], 0, 0, "th", "col"), (*key, tables[0], 1, 1, None, ""), (*key, tables[0], 7, 7, "th", None)], "book string, doc string, table_eid int, row int, col int, tag string, scope string")
    heads = spark.createDataFrame([(*key, tables[0], 1, 0, 0, 0), (*key, tables[0], 1, 0, 0, 1), (*key, tables[0], 1, 0, 1, 0)], "book string, doc string, table_eid int, row int, col int, header_row int, header_col int")
    made, skipped = views.table_edits(cells, two, captions, changed, heads)
    assert Counter(r.reason for r in skipped.collect()) == {"no table": 1, "no cell": 1, "itself": 1}
    entries = rewrite_entries(pub.entries.where("book = 'trades'"), made)
    after = model.publication(entries.where("name is not null")).elements.where("doc = 'text/two.xhtml'")
    assert [r.text for r in after.where("tag = 'caption'").orderBy("eid").collect()][:2] == ["Wool & more", "Other"]
    got = {(r.table_eid, r.row, r.col): r for r in model.table_cells(after).collect()}
    first = min(t for t, _, _ in got)
    assert (got[first, 0, 0].tag, got[first, 0, 0].scope, got[first, 1, 1].scope) == ("th", "col", None)
    assert got[first, 1, 0].headers == [got[first, 0, 0].id, got[first, 0, 1].id] and all(got[first, 1, 0].headers)


def test_batches_in_full(pub):
    graph = notes.note_graph(pub)
    runs = notes.batches(graph).where("book = 'trades'").collect()
    assert {(r.start, r.end, r.applicable, r.number) for r in runs} == {(6, 7, True, 6), (6, 7, True, 7)}
    assert notes.unmatched(graph).where("book = 'trades'").count() == 0
    kinds = {r.kind: r.json for r in notes.model_json(pub, graph).where("book = 'trades'").collect()}
    assert set(kinds) == {"ref", "note", "edge", "batch"} and '"context":' in kinds["ref"]
    found = run_checks(pub, ["heading_hierarchy", "img_alt"])
    place = pub.elements.where("tag = 'section' and doc = 'text/one.xhtml'").select("book", "doc", "path")
    from quire.plans.checks import inside

    assert inside(found, place).where("book = 'trades'").count() == 2
    assert views.illegal_lists(pub.elements.where("book = 'trades' and doc = 'text/three.xhtml'")).where("illegal").count() >= 1


def test_books_of_one_name(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.epub").write_bytes(publications.package())
    (tmp_path / "a" / "y.EPUB").write_bytes(publications.package())
    names = {r.book for r in packages.read_packages(spark, f"file://{tmp_path}/*/*").select("book").distinct().collect()}
    assert "y" in names and len(names) == 3 and {n.rsplit("/", 2)[-2] for n in names - {"y"}} == {"a", "b"}
