"""Findings kept up to date: what an edit can have changed is checked again and replaces what was stored for it.

Stored findings have a scope: the document, for checks that look at one document alone, or else the book. An edit touches documents; the names
of what it edits say which checks can tell the difference. Those run over the touched documents, or books, and one commit replaces the
rows of just these (check, book, scope), also where nothing is left to find. So the store holds what running all checks over all books would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans import notes  # noqa: F401  it registers its check
from quire.plans.checks import CHECKS, FINDING, run_checks
from quire.plans.model import KEY, Publication
from quire.sources.commits import current_rows, replace_keys

#: Checks that look at one document alone; all others look at the book.
OF_DOCUMENT = ["img_alt", "heading_hierarchy", "lang", "duplicate_id", "table_a11y", "list_a11y"]
#: Which checks see an edit of a name; edits of any other name are seen by all.
SEEN_BY = {
    "alt": ["img_alt"], "lang": ["lang"], "xml:lang": ["lang"], "heading_level": ["heading_hierarchy", "toc"], "epub:type": ["note_a11y", "toc", "list_a11y"], "role": ["note_a11y", "list_a11y", "table_a11y"],
    "id": ["duplicate_id", "broken_anchor", "toc", "note_a11y", "table_a11y"], "href": ["broken_anchor", "toc", "note_a11y"], "scope": ["table_a11y"], "headers": ["table_a11y"], "start": ["list_a11y"], "value": ["list_a11y"],
}
SCOPE = ["check", "book", "scope"]
STORED = "check string, book string, scope string, rule string, severity string, doc string, path string, args map<string, string>"


def scoped(findings: DataFrame) -> DataFrame:
    return findings.withColumn("scope", F.when(F.col("check").isin(*OF_DOCUMENT), F.coalesce("doc", F.lit(""))).otherwise("")).select(*[c.split()[0] for c in STORED.split(", ")[:7]], "args")


def store_all(path: str, pub: Publication, checks: list[str] | None = None) -> int:
    """Runs all checks, or those named, over everything and stores what they find; the commit's number."""
    found = scoped(run_checks(pub, checks))
    names = pub.spine.sparkSession.createDataFrame([(c, c in OF_DOCUMENT) for c in checks or CHECKS], "check string, own boolean")
    every = pub.spine.select(*KEY).distinct().join(F.broadcast(names)).select("check", "book", F.when(F.col("own"), F.col("doc")).otherwise("").alias("scope"))
    return replace_keys(path, found, SCOPE, scope=every.distinct())


def touched_scopes(edits: DataFrame) -> DataFrame:
    """(check, book, scope) that edits (book, doc, name, ...) can have changed."""
    seen = F.create_map(*[x for k, v in SEEN_BY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    checks = F.coalesce(F.try_element_at(seen, F.col("name")), F.array(*map(F.lit, CHECKS)))
    rows = edits.select(*KEY, "name").distinct().select(*KEY, F.explode(checks).alias("check"))
    return rows.select("check", "book", F.when(F.col("check").isin(*OF_DOCUMENT), F.col("doc")).otherwise("").alias("scope")).distinct()


def part_of(pub: Publication, docs: DataFrame | None, books: DataFrame) -> Publication:
    """The publication of some books and, if given, some of their documents (book, doc)."""
    keep = lambda df: df.join(books, "book", "left_semi")
    own = lambda df: keep(df) if docs is None else df.join(docs, KEY, "left_semi")
    return Publication(keep(pub.entries), own(pub.elements), keep(pub.manifest), own(pub.spine), keep(pub.toc))


def refresh(path: str, pub: Publication, edits: DataFrame, checks: list[str] | None = None) -> int:
    """Checks again what edits touched, in the publication as it is after them, and replaces it in the store; the commit's number. checks: those that are stored, if not all."""
    scopes = touched_scopes(edits).where(F.col("check").isin(*(checks or CHECKS))).persist()
    names = {r[0] for r in scopes.select("check").distinct().collect()}  # of the checks that there are
    found = []
    for check in sorted(names):
        mine = scopes.where(F.col("check") == check)
        books = mine.select("book").distinct()
        docs = mine.select("book", F.col("scope").alias("doc")) if check in OF_DOCUMENT else None
        found.append(CHECKS[check](part_of(pub, docs, books)).select(*FINDING))
    new = found[0] if found else run_checks(part_of(pub, None, pub.entries.select("book").limit(0)))
    for more in found[1:]:
        new = new.unionByName(more)
    number = replace_keys(path, scoped(new), SCOPE, scope=scopes)
    scopes.unpersist()
    return number


def findings(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The findings that hold, or held after a commit."""
    return current_rows(spark, path, SCOPE, STORED, upto).select(*FINDING)
