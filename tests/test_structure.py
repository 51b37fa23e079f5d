import random

from pyspark.sql import functions as F

from quire.plans.structure import preview, restructure
from quire.sources.markup import ELEMENTS, rewrite_text, shred, shred_runs, shred_text

NAMES = [x.split()[0] for x in ELEMENTS.split(", ")]
DOCS = "book string, doc string, html string"
EDITS = "book string, doc string, path string, name string, value string"


def markup(draw, depth=0):
    out = []
    for _ in range(draw.randrange(1, 5)):
        kind = draw.random()
        if kind < 0.35:
            out.append(draw.choice(["x", " y ", "one &amp; two", "\n", "é ", "z" * 150, "a < b"]))
        elif kind < 0.42:
            out.append("<!-- c -->")
        elif kind < 0.5:
            out.append("<br/>")
        elif depth < 5:
            tag = draw.choice("p p a nav table tr td div ul li b section h2".split())
            out.append(f"<{tag}{draw.choice(['', ' id=\"i\"', ' class=\"\"'])}>{markup(draw, depth + 1)}</{tag}>")
    return "".join(out)


FRAGMENTS = ["<b>new</b>", "text", "x<!-- n -->y", "<p>a<br/>b <a href='#x'>c</a></p>tail", "<table><tr><td>1</td></tr></table>", "head<br/>", ""]


def chosen(draw, rows):
    edits = []
    for row in rows:
        if draw.random() < 0.3:
            for name in draw.sample(["remove", "wrap", "before", "append", "text"], draw.choice([1, 1, 1, 2, 3])):
                if row["tag"] == "br" and name in ("append", "text"):
                    continue
                value = {"remove": draw.choice(["", None]), "wrap": draw.choice(["div", "a href=\"#q\"", "nav", "p"]), "text": draw.choice(["", "new <t>", "z" * 210])}.get(name) if name in ("remove", "wrap", "text") else draw.choice(FRAGMENTS)
                edits.append((row["path"], name, value))
    return edits


def as_rows(parsed, book, doc):
    return {(book, doc, r["eid"]): tuple(dict(r[n]) if n == "attrs" else r[n] for n in NAMES[2:]) for r in parsed}


def collected(df):
    rows = df.select(*NAMES).collect()
    found = {(r.book, r.doc, r.eid): tuple(r)[2:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_as_parsed_again(spark):
    draw, docs, edits, want = random.Random(7), [], [], {}
    for i in range(150):
        html = f"<html><body>{markup(draw)}</body></html>"
        mine = chosen(draw, shred_text(html, False)) if i % 10 else []
        docs.append(("b", str(i), html))
        edits += [("b", str(i), *e) for e in mine]
        by_path = {}
        for path, name, value in sorted(mine, key=lambda e: (e[0], e[1], e[2] or "")):
            by_path.setdefault(path, {})[name] = value
        want |= as_rows(shred_text(rewrite_text(html, by_path), False), "b", str(i))
    frame = spark.createDataFrame(docs, DOCS)
    got, bad = restructure(shred(frame, "book", "doc", "html"), shred_runs(frame, "book", "doc", "html"), spark.createDataFrame(edits, EDITS))
    found = collected(got)
    wrong = [k for k in want | found if want.get(k) != found.get(k)]
    assert not wrong and bad.count() == 0 and len(edits) > 200


def test_attributes_and_structure_together(spark):
    html = "<html><body><nav><a href='#x'>go</a></nav><h2>t</h2><!-- c --><table><tr><td>1</td></tr></table><p>a<br/>b</p></body></html>"
    edits = {
        "html[1]/body[1]/h2[1]": {"heading_level": "1", "id": "i"}, "html[1]/body[1]/nav[1]": {"remove": ""}, "html[1]/body[1]/table[1]/tr[1]": {"before": "<caption>c</caption>"},
        "html[1]/body[1]/table[1]/tr[1]/td[1]": {"tag": "th", "scope": "col", "wrap": "b"}, "html[1]/body[1]/p[1]": {"append": "<h1>end</h1>"},
    }
    docs = spark.createDataFrame([("b", "1", html), ("b", "2", html), ("b", "3", None), ("c", "1", "")], DOCS)
    listed = [("b", "1", path, k, v) for path, named in edits.items() for k, v in named.items()]
    refused = [("b", "2", "html[1]/body[1]/p[9]", "remove", "", "element"), ("b", "2", "html[1]", "wrap", "1x", "value"), ("b", "2", "html[1]", "before", "<i/>", None), ("b", "2", "html[1]/body[1]", "style", "x", "attribute")]
    given = spark.createDataFrame([*listed, *[r[:5] for r in refused]], EDITS)
    got, bad = preview(shred(docs, "book", "doc", "html").withColumn("ups", F.lit("clash")), shred_runs(docs, "book", "doc", "html"), given)
    assert collected(got) == as_rows(shred_text(rewrite_text(html, edits), False), "b", "1") | as_rows(shred_text(html, False), "b", "2")
    assert sorted(tuple(r) for r in bad.collect()) == sorted(r for r in refused if r[5])


def test_nothing_to_do(spark):
    docs = spark.createDataFrame([("b", "1", "<p>x</p>")], DOCS)
    none = spark.createDataFrame([], EDITS)
    elements, runs = shred(docs, "book", "doc", "html"), shred_runs(docs, "book", "doc", "html")
    assert collected(preview(elements, runs, none)[0]) == as_rows(shred_text("<p>x</p>", False), "b", "1")
    got, bad = preview(elements.where("false"), runs.where("false"), spark.createDataFrame([("b", "1", "p[1]", "remove", None)], EDITS))
    assert got.count() == 0 and [r.reason for r in bad.collect()] == ["element"]
    gone, _ = restructure(elements, runs, spark.createDataFrame([("b", "1", "p[1]", "remove", None)], EDITS))
    assert gone.count() == 0
