import random

import pytest
from pyspark.sql import functions as F

from quire.operators.changes import set_attributes
from quire.plans import model, refresh
from quire.plans.checks import CHECKS, run_checks

from . import publications


@pytest.fixture(scope="module")
def pub(spark):
    rows = [(b, n, bytearray(c), i, None) for b in ("one", "two") for i, (n, c) in enumerate(publications.files().items())]
    return model.publication(spark.createDataFrame(rows, "book string, name string, content binary, ord int, error string"))


def found(df):
    return sorted((r.check, r.rule, r.severity, r.book, str(r.doc), str(r.path), tuple(sorted(r.args.items()))) for r in df.collect())


VALUES = {"alt": ["x", None], "lang": ["en", None], "heading_level": ["2", "5"], "epub:type": ["footnote", None], "role": ["presentation", None], "id": ["tide", "fresh", None], "href": ["#none", "two.xhtml"], "scope": ["row", None], "start": ["x", "3"]}


@pytest.mark.parametrize("checks", [["img_alt", "heading_hierarchy", "lang", "duplicate_id", "broken_anchor", "toc"], ["list_a11y"], ["table_a11y"], ["note_a11y"]])
def test_refreshed_is_recomputed(spark, pub, tmp_path, checks):
    path = str(tmp_path / "findings")
    refresh.store_all(path, pub, checks)
    draw = random.Random(3)
    elements = pub.elements.where("book = 'one' and doc like 'text/%xhtml'").select("book", "doc", "path", "tag", "attrs").collect()
    rows = []
    for name, choices in VALUES.items():
        for r in draw.sample([e for e in elements if name in e.attrs or draw.random() < 0.2 and (name != "heading_level" or e.tag in ("h1", "h2", "h3"))], 3):
            rows.append((r.book, r.doc, r.path, name, draw.choice(choices)))
    edits = spark.createDataFrame(rows, "book string, doc string, path string, name string, value string")
    changed, _ = set_attributes(pub.elements, edits)
    after = pub._replace(elements=changed.persist())
    refresh.refresh(path, after, edits, checks)
    assert found(refresh.findings(spark, path)) == found(run_checks(after, checks))
    assert found(refresh.findings(spark, path, upto=1)) == found(run_checks(pub, checks))  # as it was


def test_only_what_an_edit_touches(spark, pub):
    edits = spark.createDataFrame([("one", "text/one.xhtml", "alt"), ("one", "text/two.xhtml", "href"), ("two", "text/two.xhtml", "remove")], "book string, doc string, name string")
    got = {tuple(r) for r in refresh.touched_scopes(edits).collect()}
    assert {r for r in got if r[1] == "one"} == {("img_alt", "one", "text/one.xhtml"), ("broken_anchor", "one", ""), ("toc", "one", ""), ("note_a11y", "one", "")}
    assert {r[0] for r in got if r[1] == "two"} == set(CHECKS)
    some = refresh.part_of(pub, edits.select("book", "doc").where("book = 'one'"), spark.createDataFrame([("one",)], "book string"))
    assert {(r.book, r.doc) for r in some.elements.select("book", "doc").distinct().collect()} == {("one", "text/one.xhtml"), ("one", "text/two.xhtml")}
    assert some.entries.select(F.countDistinct("book")).first()[0] == 1
