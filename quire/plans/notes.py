"""The graph of note references, notes and links back; its findings, batches of undeclared pairs, and listening order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import any_token, is_external, note_mark, note_number, reference_parts, resolve
from quire.operators.graph import cycle_members
from quire.operators.lineage import cut
from quire.operators.matching import duplicate_numbers, first_by
from quire.operators.ordered import narration
from quire.plans.checks import finding, register_check, together
from quire.plans.model import KEY, Publication, above, first_ids, in_spine, kept, up_from
from quire.sources.markup import attr

NOTE_TAGS = ["aside", "section", "div", "li"]


class NoteGraph(NamedTuple):
    notes: DataFrame
    refs: DataFrame  # with status and note, the key of the note that it resolves to
    edges: DataFrame  # ref, note
    backlinks: DataFrame  # note, ref, external
    sections: DataFrame  # book, doc of the chapters with a section of footnotes


def role():
    return F.lower(F.trim(F.coalesce(attr("role"), F.lit(""))))


def own_type():
    """footnote before endnote, types before roles."""
    kind = attr("epub:type")
    return F.when(any_token(kind, "footnote"), "footnote").when(any_token(kind, "endnote"), "endnote").when(role() == "doc-footnote", "footnote").when(role() == "doc-endnote", "endnote")


def key(eid: str = "eid"):
    return F.concat_ws("|", "book", "doc", eid)


def leads_away(refs: DataFrame) -> Column:
    """Whether a reference leads to another document of its book; those that don't are looked up where their document's elements lie."""
    return F.coalesce(~F.col("external") & (F.col("target") != F.col("doc")), F.lit(False))


def note_graph(pub: Publication) -> NoteGraph:
    kind = attr("epub:type")
    section = F.when(any_token(kind, "endnotes"), "endnote").when(any_token(kind, "footnotes"), "footnote")
    elements = in_spine(pub).withColumns({"own": own_type(), "section": section})
    flagged = elements.where("own is not null or section is not null").select(*KEY, "eid", F.col("own").isNotNull().alias("note_up"), F.col("section").isNotNull().alias("section_up"))
    placed = above(elements, flagged, "note_up", "section_up")
    sections = elements.where("section is not null").select(*KEY, F.col("eid").alias("section_up"), F.col("section").alias("in_section"))
    placed = placed.join(sections, [*KEY, "section_up"], "left").where("not in_nav and tag <> 'nav'")
    placed = kept(placed.select(*KEY, "spine_pos", "eid", "last", "path", "tag", "text", "attrs", "anchor", "chain", "own", "in_section", "note_up"), pub)

    number = note_number(F.col("text"))
    found = placed.where(F.col("tag").isin(*NOTE_TAGS) & (F.col("own").isNotNull() | F.col("in_section").isNotNull()) & (F.col("note_up").isNull() | F.col("own").isNotNull()))
    notes = found.withColumns({"number": number, "declared": F.col("own").isNotNull()}).withColumn("mixed", ~F.col("declared") & (F.col("tag") == "li") & F.col("number").isNull())
    notes = notes.where("declared or number is not null or mixed").select(
        *KEY, "spine_pos", "eid", "last", "path", "tag", key().alias("note"), attr("id").alias("el_id"), "declared", F.coalesce("own", "in_section").alias("note_type"),
        "number", note_mark(F.col("text")).alias("marker"), "mixed", F.col("note_up").isNotNull().alias("nested"), F.substring("text", 1, 60).alias("text"),
    )
    notes = kept(notes, pub)

    declared = (F.col("tag") == "a") & (any_token(kind, "noteref") | (role() == "doc-noteref"))
    marks = placed.where("tag in ('a', 'sup', 'span')").withColumns({"declared": declared, "number": note_number(F.col("text"), whole=True), "href": F.when(F.col("tag") == "a", attr("href"))})
    wrapped = marks.where("declared").select(*KEY, F.col("eid").alias("anchor"), F.lit(True).alias("_wrapped"))
    marks = marks.join(wrapped, [*KEY, "anchor"], "left").where((F.col("tag") == "a") | F.col("_wrapped").isNull())
    hinted = (F.col("tag") == "span") & F.coalesce(attr("class"), F.lit("")).rlike("(?i)note|fn")
    marks = marks.where(F.col("declared") | (F.col("number").isNotNull() & ((F.col("tag") == "sup") | hinted | ((F.col("tag") == "a") & (F.coalesce("href", F.lit("")) != "")))))
    refs = marks.select(
        *KEY, "spine_pos", "eid", "path", "tag", key().alias("ref"), attr("id").alias("el_id"), "declared", "number", F.coalesce(F.nullif(note_mark(F.col("text")), F.lit("")), F.substring("text", 1, 8)).alias("marker"),
        F.nullif("href", F.lit("")).alias("href"), F.when(F.col("note_up").isNotNull(), key("note_up")).alias("within"),
    )
    target, frag = resolve(F.col("doc"), F.col("href")), reference_parts(F.col("href"))[1]
    refs = refs.withColumns({"external": F.coalesce(is_external(F.col("href")), F.lit(False)), "target": target, "frag": frag})
    files = pub.entries.select("book", F.col("name").alias("target"), F.lit(True).alias("_file")).distinct()
    ids = first_ids(pub.elements).select(*KEY, F.col("id").alias("frag"), F.col("eid").alias("_eid"))
    ids = ids.join(placed.select(*KEY, F.col("eid").alias("_eid"), F.col("note_up").alias("_up")), [*KEY, "_eid"], "left")
    at = notes.select(*KEY, F.col("eid").alias("_eid"), F.col("note").alias("_note"))
    around = at.withColumnsRenamed({"_eid": "_up", "_note": "_inner"})
    ids = ids.join(at, [*KEY, "_eid"], "left").join(around, [*KEY, "_up"], "left")
    far = leads_away(refs)
    near = refs.where(~far).withColumn("_file", F.lit(True)).join(ids, [*KEY, "frag"], "left")
    away = refs.where(far).join(files, ["book", "target"], "left").join(ids.withColumnRenamed("doc", "target"), ["book", "target", "frag"], "left")
    joined = near.unionByName(away.repartition(pub.parts, *KEY) if pub.parts else away)
    status = (
        F.when(F.col("href").isNull(), "none").when(F.col("external"), "external").when(F.col("_file").isNull(), "missing_doc").when(F.col("frag") == "", "none")
        .when(F.col("_eid").isNull(), "missing_frag").when(F.col("_note").isNotNull(), "note").when(F.col("_inner").isNotNull(), "note_inner")
        .otherwise(F.when(F.col("declared"), "nonnote").otherwise("none"))
    )
    refs = joined.withColumns({"status": status, "note": F.coalesce("_note", "_inner")}).drop("_file", "_eid", "_up", "_note", "_inner")
    refs = kept(refs.withColumn("note", F.when(F.col("status").isin("note", "note_inner"), F.col("note"))), pub)
    edges = refs.where("note is not null").select("book", "ref", "note")

    anchors = placed.where("tag = 'a' and map_contains_key(attrs, 'href')").withColumn("href", attr("href"))
    inside = anchors.select(*KEY, "eid", "href", "text").join(up_from(anchors).withColumnRenamed("up", "_up"), [*KEY, "eid"])
    inside = inside.join(notes.select(*KEY, F.col("eid").alias("_up"), "note"), [*KEY, "_up"]).withColumns({"external": is_external(F.col("href")), "target": resolve(F.col("doc"), F.col("href")), "frag": reference_parts(F.col("href"))[1]})
    firsts = first_by(refs.where("el_id is not null"), ["book", "doc", "el_id"], ["eid"]).select(*KEY, F.col("el_id").alias("frag"), "ref")
    inside = inside.where(F.col("external") | F.col("href").contains("#"))
    far = leads_away(inside)
    backlinks = inside.where(~far).join(firsts, [*KEY, "frag"], "left").unionByName(inside.where(far).join(firsts.withColumnRenamed("doc", "target"), ["book", "target", "frag"], "left"))
    return NoteGraph(notes, refs, edges, backlinks.select(*KEY, "eid", "note", F.when(~F.col("external"), F.col("ref")).alias("ref"), "external", "href", F.substring("text", 1, 12).alias("text")), elements.where(any_token(kind, "footnotes")).select(*KEY).distinct())


def note_findings(graph: NoteGraph) -> DataFrame:
    notes, refs, edges = graph.notes, graph.refs, graph.edges
    incoming = edges.groupBy("note").agg(F.count("*").alias("incoming"))
    counted = notes.join(incoming, "note", "left").withColumn("incoming", F.coalesce("incoming", F.lit(0)))
    linked = refs.where("note is not null").join(notes.select("note", F.col("doc").alias("note_doc"), "note_type", F.col("declared").alias("note_declared")), "note")
    sections = graph.sections.withColumnRenamed("doc", "note_doc")
    lacking = linked.where("el_id is not null").join(graph.backlinks.where("ref is not null").select("note", "ref"), ["note", "ref"], "left_anti").join(incoming, "note")
    scope = F.when(F.col("note_type") == "footnote", F.col("doc")).otherwise("*")
    repeated = duplicate_numbers(notes.where("number is not null").withColumn("scope", scope), ["book", "note_type", "scope", "number"], ["spine_pos", "eid"])
    hops = refs.where("within is not null and note is not null").select(F.col("within").alias("u"), F.col("note").alias("v"))
    cycles = cycle_members(hops, "u", "v").withColumnRenamed("node", "note").join(notes, "note")
    check = "note_a11y"
    return together([
        finding(refs.where("not declared and note is not null"), check, "NOTE.REF_UNDECL_LINKED", "warning", marker=F.col("marker")),
        finding(refs.where("not declared and tag <> 'a'"), check, "NOTE.REF_UNDECL", "warning", marker=F.col("marker")),
        finding(notes.where("mixed"), check, "NOTE.MIXED_LI", "warning"),
        finding(notes.where("not declared and not mixed"), check, "NOTE.UNDECL", "warning", number=F.col("number")),
        finding(refs.where("status = 'external'"), check, "NOTE.REF_EXTERNAL", "error", href=F.col("href")),
        finding(refs.where("declared and status = 'nonnote'"), check, "NOTE.TARGET_NOT_NOTE", "error", href=F.col("href")),
        finding(linked.where("declared and note_type = 'footnote' and note_doc <> doc").join(sections, ["book", "note_doc"], "left_semi"), check, "NOTE.CROSS_CHAPTER", "error", note=F.col("note")),
        finding(linked.where("el_id is null"), check, "NOTE.REF_NO_ID", "warning", note=F.col("note")),
        finding(lacking.where("incoming > 1"), check, "NOTE.NO_BACKLINK_SHARED", "warning", note=F.col("note")),
        finding(lacking.where("incoming = 1"), check, "NOTE.NO_BACKLINK_SINGLE", "warning", note=F.col("note")),
        finding(counted.where("incoming > 1"), check, "NOTE.MULTI_REF", "warning", incoming=F.col("incoming")),
        finding(graph.backlinks.where("external").join(notes.select("note", "path"), "note"), check, "NOTE.BACKLINK_EXTERNAL", "error", href=F.col("href")),
        finding(repeated, check, "NOTE.DUP_NUMBER", "error", number=F.col("number"), members=F.col("members")),
        finding(counted.where("incoming = 0 and not mixed and not nested"), check, "NOTE.ORPHAN", "warning"),
        finding(notes.where("nested"), check, "NOTE.NESTED", "error"),
        finding(cycles, check, "NOTE.CYCLE", "error", component=F.col("component")),
    ])


def with_context(pub: Publication, refs: DataFrame) -> DataFrame:
    """Adds context: the first 40 characters of the text of what a reference stands in."""
    placed = in_spine(pub)
    up = refs.select("ref", *KEY, "eid").join(placed.select(*KEY, "eid", "parent"), [*KEY, "eid"])
    texts = placed.select(*KEY, F.col("eid").alias("parent"), F.substring("text", 1, 40).alias("context"))
    return refs.join(up.join(texts, [*KEY, "parent"]).select("ref", "context"), "ref", "left").withColumn("context", F.coalesce("context", F.lit("")))


def model_json(pub: Publication, graph: NoteGraph) -> DataFrame:
    """(book, kind, key, json): references, notes, links and batches as JSON objects, one a row."""
    refs = with_context(pub, graph.refs)
    backs = graph.backlinks.groupBy("note").agg(F.array_sort(F.collect_list(F.struct("href", "external", "ref", "text"))).alias("backlinks"))
    held = graph.edges.groupBy("note").agg(F.array_sort(F.collect_list("ref")).alias("refs"))
    notes = graph.notes.join(backs, "note", "left").join(held, "note", "left").withColumn("orphan", F.col("refs").isNull() & ~F.col("mixed") & ~F.col("nested"))
    as_json = lambda df, kind, key, *columns: df.select("book", F.lit(kind).alias("kind"), F.col(key).alias("key"), F.to_json(F.struct(*columns)).alias("json"))
    return together([
        as_json(refs, "ref", "ref", "ref", "doc", "path", "tag", "el_id", "declared", "number", "marker", "href", "external", "within", "note", "status", "context", "spine_pos"),
        as_json(notes, "note", "note", "note", "doc", "path", "tag", "el_id", "declared", "note_type", "number", "marker", "nested", "text", "refs", "backlinks", "orphan", "mixed", "spine_pos"),
        as_json(graph.edges, "edge", "ref", "ref", "note"),
        as_json(batches(graph), "batch", "ref", "batch", "start", "end", "applicable", "number", "note_type", "ref", "note", "reason"),
    ])


def paired(graph: NoteGraph) -> DataFrame:
    """Undeclared numbered references of the text with the only note of their number, or why there is none: (..., note, note_type, reason).

    Footnotes pair within a chapter, endnotes in the whole book; undeclared notes come first, and only where there is none, declared ones without references.
    """
    free = graph.refs.where("not declared and number is not null and within is null and not external and note is null").drop("note")
    free = free.withColumn("_same", F.count("*").over(Window.partitionBy(*KEY, "number")))
    candidates = graph.notes.where("number is not null").join(graph.edges.select("note").distinct().withColumn("_used", F.lit(True)), "note", "left")
    tiers = {"0": ~F.col("declared") & ~F.col("mixed"), "1": F.col("declared") & F.col("_used").isNull()}

    def held(some: DataFrame, by: list[str], name: str) -> DataFrame:
        """How many notes of each number there are in each tier, and one of them: as many rows as numbers, so that no reference meets every note of its number."""
        each = [x for t, of in tiers.items() for x in (F.count(F.when(of, 1)).alias(f"_{name}n{t}"), F.min(F.when(of, F.struct("note", "note_type"))).alias(f"_{name}c{t}"))]
        return some.groupBy(*by, "number").agg(*each)

    own, ends = held(candidates.where("note_type <> 'endnote'"), KEY, "own"), held(candidates.where("note_type = 'endnote'"), ["book"], "end")
    joined = free.join(own, [*KEY, "number"], "left").join(ends, ["book", "number"], "left")
    n = lambda t: F.coalesce(f"_ownn{t}", F.lit(0)) + F.coalesce(f"_endn{t}", F.lit(0))
    only = lambda t: F.when(n(t) == 1, F.coalesce(f"_ownc{t}", f"_endc{t}"))
    joined = joined.withColumn("c", F.when(F.col("_same") == 1, F.when(n("0") > 0, only("0")).otherwise(only("1"))))
    reason = F.when(F.col("_same") > 1, "number repeated in the chapter").when(F.col("c").isNull(), "no only note of the number")
    return joined.select(*free.drop("_same").columns, "c.note", "c.note_type", reason.alias("reason"))


def unmatched(graph: NoteGraph) -> DataFrame:
    """(book, doc, path, number, reason) of the references that no batch has."""
    return paired(graph).where("reason is not null").select(*KEY, "path", "number", "reason")


def batches(graph: NoteGraph) -> DataFrame:
    """Paired references in runs of rising numbers of one chapter and type: (book, doc, batch, start, end, applicable, number, note_type, ref, note, reason).

    A run's items are of one type, so that all of them are applicable.
    """
    matched = paired(graph).where("reason is null")
    w = Window.partitionBy(*KEY).orderBy("number", "note_type", "eid")
    new = (F.col("number") != F.lag("number").over(w) + 1) | (F.col("note_type") != F.lag("note_type").over(w))
    runs = matched.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("batch", F.sum("_new").over(w))
    run = Window.partitionBy(*KEY, "batch")
    return runs.select(*KEY, "batch", F.min("number").over(run).alias("start"), F.max("number").over(run).alias("end"), F.lit(True).alias("applicable"), "number", "note_type", "ref", "note", F.lit("").alias("reason"))


def listening_order(graph: NoteGraph) -> DataFrame:
    """Lines as they are heard: each reference in the text, its note or a warning, the way back or a warning; then orphans."""
    refs = graph.refs.where("within is null")
    base = refs.select("book", "spine_pos", "eid", "doc", "path", "ref", "note", "marker", "status")
    notes = graph.notes.select("note", F.col("text").alias("note_text"), F.col("path").alias("note_path"), F.col("doc").alias("note_doc"))
    heard = base.join(notes, "note", "left")
    back = graph.backlinks.where("ref is not null").select("note", "ref").distinct().withColumn("_back", F.lit(True))
    heard = cut(heard.join(back, ["note", "ref"], "left"))
    line = lambda df, sub, kind, doc, path, text: df.select("book", "spine_pos", "eid", F.lit(sub).alias("sub"), F.when(kind, F.lit("warn")).otherwise(F.lit({0: "ref", 1: "note", 2: "back", 3: "note"}[sub])).alias("kind"), F.col(doc).alias("doc"), F.col(path).alias("path"), text.alias("text"))
    orphans = graph.notes.where("not nested and not mixed").join(graph.edges.select("note").distinct(), "note", "left_anti").withColumn("spine_pos", F.lit(2**30))
    parts = [
        line(heard, 0, F.lit(False), "doc", "path", F.col("marker")),
        line(heard, 1, F.col("note").isNull(), "doc", "path", F.coalesce("note_text", "status")),
        line(heard.where("note is not null"), 2, F.col("_back").isNull(), "note_doc", "note_path", F.when(F.col("_back").isNull(), "no way back").otherwise(F.col("marker"))),
        line(orphans, 3, F.lit(True), "doc", "path", F.col("text")),
    ]
    return narration(parts, ["book"], ["spine_pos", "doc", "eid", "sub"]).select("book", "line", "kind", "doc", "path", "text")


def note_a11y(pub: Publication) -> DataFrame:
    return note_findings(note_graph(pub))


register_check("note_a11y", note_a11y)
