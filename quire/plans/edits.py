"""Edits of notes as rows of markup edits, with their guards; and the stored log of changes with its inverses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import is_external, relative, tokens
from quire.operators.changes import EDITABLE, apply_undo
from quire.operators.lineage import cut
from quire.operators.report import escaped
from quire.plans.model import KEY, Publication, in_spine, links, up_from
from quire.plans.notes import NOTE_TAGS, NoteGraph, batches, own_type
from quire.sources.commits import commit, committed, new_run, write_part
from quire.sources.markup import attr

#: The types that an edit may mark, with their roles.
ROLES = {"noteref": "doc-noteref", "footnote": "doc-footnote", "endnote": "doc-endnote"}
#: An asked-for edit: what it is, the keys (book|doc|number) of the reference and of the note or element, a type or reference, and a label.
ASKED = "kind string, ref string, note string, value string, label string"
EDIT = ["book", "doc", "path", "name", "value"]
INVERSE = "array<struct<book: string, doc: string, path: string, name: string, value: string>>"


def key_parts(key: str) -> tuple[Column, Column, Column]:
    """(book, doc, eid) of a key."""
    parts = F.split(F.col(key), r"\|", 3)
    return parts[0], parts[1], F.try_element_at(parts, F.lit(3)).try_cast("int")


def incoming_sources(pub: Publication, targets: DataFrame) -> DataFrame:
    """(book, doc, eid, from_doc, text): links in the reading order that lead to one of targets (book, doc, eid) or to an id inside it.

    Ids meet their ancestors by `chain`, links their targets by an equi join.
    """
    ids = pub.elements.where(attr("id").isNotNull())
    within = up_from(ids).union(ids.select(*KEY, "eid", F.col("eid").alias("up"))).join(targets.select(*KEY, F.col("eid").alias("up")).distinct(), [*KEY, "up"])
    named = within.join(ids.select(*KEY, "eid", attr("id").alias("frag")), [*KEY, "eid"]).select("book", F.col("doc").alias("target"), "frag", F.col("up").alias("at")).distinct()
    found = links(in_spine(pub)).where(F.col("href").contains("#") & ~is_external(F.col("href")))
    return found.join(named, ["book", "target", "frag"]).select("book", F.col("target").alias("doc"), F.col("at").alias("eid"), F.col("doc").alias("from_doc"), F.col("path").alias("from_path"), F.substring("text", 1, 8).alias("text"))


#: The order in which the parts of a request take effect; within a part, rows go by nth.
STAGES = ["unlink", "delete", "mark", "unmark", "link", "backlink", "unback", "batch"]


def allot_ids(wants: DataFrame, used: DataFrame) -> DataFrame:
    """wants (key, book, doc, base, place) with id: of each base the k-th want, by place, gets the k-th of base, base-2, base-3, ... that used (book, doc, id) lacks.

    With u the r-th number in use, u - r numbers below it are free; so the k-th free one is k and as many more as there are r with u - r < k.
    """
    bases = wants.select(*KEY, "base").distinct()
    near = bases.join(used.select(*KEY, "id").distinct(), KEY).where(F.col("id").eqNullSafe(F.col("base")) | F.col("id").startswith(F.concat("base", F.lit("-"))))
    number = F.when(F.col("id") == F.col("base"), F.lit(1)).otherwise(F.expr("substring(id, length(base) + 2)").try_cast("int"))
    # only the id that the number gives back is in use: x-02 isn't x-2
    same = F.col("id") == F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string")))
    numbered = near.withColumn("n", number).where((F.col("n") >= 1) & same).select(*KEY, "base", "n").distinct()
    ranked = numbered.withColumn("r", F.row_number().over(Window.partitionBy(*KEY, "base").orderBy("n"))).select(*KEY, "base", "r", (F.col("n") - F.col("r")).alias("below"))
    placed = wants.withColumn("k", F.row_number().over(Window.partitionBy(*KEY, "base").orderBy("place", "key")))
    more = placed.join(ranked, [*KEY, "base"]).where("below < k").groupBy("key").agg(F.max("r").alias("more"))
    n = F.col("k") + F.coalesce("more", F.lit(0))
    return placed.join(more, "key", "left").select("key", *KEY, F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("id"))


def note_edits(pub: Publication, graph: NoteGraph, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits (book, doc, path, name, value), refused (kind, ref, note, reason)) for asked (see ASKED; nth, if there, is a number that orders rows of a kind).

    kind is unlink (ref), delete (note), mark or unmark (note, value is the type; a reference's key is fine), link (ref, note, value an optional reference),
    backlink (ref, note, label), unback (ref, note), which takes a way back away, or batch (ref is `book|doc`, value the number of one of `notes.batches`).
    The kinds take effect in the order of STAGES, whatever the order of the rows, and each is judged on what the ones before it leave: links that are cut
    don't stop a delete, what is deleted is nowhere any more and its ids are free, a note that is marked can be linked, one that is unmarked can't. Of marks
    of one element, and links of one reference, the last holds. A batch's undeclared notes are marked, its references linked, and each gets a way back.
    The edits are for `markup.rewrite_entries`: one of a name for each element. Refused are: a delete of what is still
    referred to, unknown types, types of notes on other elements than aside, section, div and li, links to what isn't declared, external references, batches that aren't there and keys of nothing.
    If anything is refused the caller applies nothing; `views.note_guard` then judges the graph of the edited package.
    """
    elements = in_spine(pub).select(*KEY, "spine_pos", "eid", "last", "parent", "path", "tag", "attrs")
    fields = (*KEY, "spine_pos", "eid", "path", "tag", "attrs")
    at = lambda name: elements.select(F.concat_ws("|", *KEY, "eid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in fields])
    asked = asked if "nth" in asked.columns else asked.withColumn("nth", F.lit(0))
    asked = asked.select("kind", "ref", "note", "value", "label", F.col("nth").cast("long").alias("nth"))
    # batches become marks, links and ways back of their own, after all others
    listed = batches(graph).select(F.concat_ws("|", *KEY).alias("of"), F.col("batch").cast("string").alias("value"), F.col("ref").alias("b_ref"), F.col("note").alias("b_note"), "note_type", "number")
    wanted = asked.where("kind = 'batch'").withColumnRenamed("ref", "of").select("of", "value", "nth").join(listed, ["of", "value"], "left")
    absent = wanted.where("b_ref is null").select(F.lit("batch").alias("kind"), F.col("of").alias("ref"), F.lit(None).cast("string").alias("note"), F.lit("batch").alias("reason"))
    items = wanted.where("b_ref is not null")
    part = lambda kind, value: items.select(F.lit(kind).alias("kind"), F.col("b_ref").alias("ref"), F.col("b_note").alias("note"), value.alias("value"), F.lit(None).cast("string").alias("label"), "nth", F.col("number").cast("long").alias("number"))
    none = F.lit(None).cast("string")
    of_batch = part("mark", F.col("note_type")).unionByName(part("link", none)).unionByName(part("backlink", none))
    rows = asked.where("kind <> 'batch' or kind is null").withColumn("number", F.lit(None).cast("long")).unionByName(of_batch).withColumn("batched", F.col("number").isNotNull())
    rows = rows.join(at("ref"), "ref", "left").join(at("note"), "note", "left")
    marks_ref = F.col("kind").isin("unlink", "link", "backlink", "unback")
    marks_note = F.col("kind").isin("delete", "mark", "unmark", "link", "backlink", "unback")

    # what is deleted, with all that it holds; what can't be deleted stays
    cut_links = rows.where("kind = 'unlink'").select(F.col("ref_book").alias("book"), F.col("ref_doc").alias("from_doc"), F.col("ref_path").alias("from_path"))
    going = rows.where("kind = 'delete'").select(F.col("note_book").alias("book"), F.col("note_doc").alias("doc"), F.col("note_eid").alias("eid"))
    held = incoming_sources(pub, going).join(cut_links, ["book", "from_doc", "from_path"], "left_anti").groupBy(F.concat_ws("|", *KEY, "eid").alias("note")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "from_doc", "text"))), ", ").alias("sources"))
    held = cut(held)
    whole = rows.where("kind = 'delete'").select("note").join(held, "note", "left_anti").join(elements.select(*KEY, "eid", "last", F.concat_ws("|", *KEY, "eid").alias("note")), "note")
    under = whole.select(*KEY, F.col("eid").alias("_from"), F.col("last").alias("_to")).distinct()
    gone = cut(elements.join(under, KEY).where("eid >= _from and eid <= _to").select(F.concat_ws("|", *KEY, "eid").alias("key")).distinct())
    lost = lambda name: gone.select(F.col("key").alias(name), F.lit(True).alias(f"{name}_lost"))
    rows = rows.join(lost("ref"), "ref", "left").join(lost("note"), "note", "left")

    # types as marks and unmarks leave them
    asked_marks = rows.where(F.col("kind").isin("mark", "unmark") & F.col("value").isin(*ROLES)).where("not (batched and kind = 'mark')")
    typed = asked_marks.groupBy("note").agg(F.max_by(F.when(F.col("kind") == "mark", F.col("value")), F.when(F.col("kind") == "mark", F.col("nth"))).alias("marked"), F.collect_set(F.when(F.col("kind") == "unmark", F.col("value"))).alias("unmarked"))
    own = elements.where(F.col("tag").isin(*NOTE_TAGS)).select(F.concat_ws("|", *KEY, "eid").alias("note"), own_type().alias("own"))
    kept_type = F.when(F.col("marked").isNull(), F.col("own")).otherwise(F.col("marked"))
    now = own.join(typed, "note", "left").select("note", F.when(~F.coalesce(F.array_contains("unmarked", kept_type), F.lit(False)) & (kept_type != "noteref"), kept_type).alias("type"))
    batched = rows.where("batched and kind = 'mark'").groupBy("note").agg(F.min("value").alias("batch_type"))
    rows = rows.join(held, "note", "left").join(now, "note", "left").join(batched, "note", "left")
    note_type = F.coalesce("type", F.when(F.col("batched"), F.col("batch_type")))
    reason = (
        F.when(~F.coalesce(F.col("kind").isin(*STAGES), F.lit(False)), "kind")
        .when((marks_ref & F.col("ref_path").isNull()) | (marks_note & F.col("note_path").isNull()), "nothing there")
        .when(~F.col("kind").isin("unlink", "delete") & ((marks_ref & F.col("ref_lost").isNotNull()) | (marks_note & F.col("note_lost").isNotNull())), "nothing there")
        .when((F.col("kind") == "delete") & F.col("sources").isNotNull(), F.concat(F.lit("referred to by "), F.col("sources")))
        .when(F.col("kind").isin("mark", "unmark") & ~F.coalesce(F.col("value").isin(*ROLES), F.lit(False)), "type")
        .when((F.col("kind") == "mark") & (F.col("value") != "noteref") & ~F.col("note_tag").isin(*NOTE_TAGS), "element")
        .when((F.col("kind") == "link") & note_type.isNull(), "not declared")
        .when((F.col("kind") == "link") & F.coalesce(is_external(F.col("value")), F.lit(False)), "external")
    )
    rows = cut(rows.withColumns({"reason": reason, "note_type": note_type, "place": F.struct(F.when(F.col("batched"), 1).otherwise(0).alias("late"), F.when(F.col("batched"), F.lit(0)).when(F.col("kind") == "link", 0).otherwise(1).alias("stage"), "nth", "number", F.when(F.col("kind") == "link", 0).otherwise(1).alias("side"))}))
    refused = rows.where("reason is not null").select("kind", "ref", "note", "reason").unionByName(absent)
    rows = rows.where("reason is null")

    edit = lambda df, side, name, value: df.select(*[F.col(f"{side}_{c}").alias(c) for c in ("book", "doc", "path")], F.lit(name).alias("name"), value.alias("value"))
    types = lambda side: tokens(F.try_element_at(f"{side}_attrs", F.lit("epub:type")))
    own_id = lambda side: F.nullif(F.try_element_at(f"{side}_attrs", F.lit("id")), F.lit(""))
    others = lambda side: F.filter(types(side), lambda t: ~t.isin(*ROLES))
    whole_type = lambda side, kind: F.array_join(F.array_sort(F.array_union(others(side), F.array(kind))), " ")
    role_of = lambda kind: F.try_element_at(F.create_map(*[F.lit(x) for p in ROLES.items() for x in p]), kind)
    anchored = lambda side: F.col(f"{side}_tag") == "a"
    wrapped = lambda *parts: F.concat(F.lit('a epub:type="noteref" role="doc-noteref"'), *parts)

    # ids: a note's fn or en and its chapter's place, a reference's ref-ch and its place; each element's first want counts
    linked = rows.where("kind = 'link'")
    backed = rows.where("kind in ('backlink', 'unback')")
    note_base = F.concat(F.when(F.col("note_type") == "endnote", "en").otherwise("fn"), F.col("note_spine_pos") + 1, F.when(F.col("batched"), "-auto").otherwise(""))
    ref_base = F.concat(F.lit("ref-ch"), F.col("ref_spine_pos") + 1, F.lit("-auto"))
    wants = linked.where(own_id("note").isNull()).select(F.col("note").alias("key"), F.col("note_book").alias("book"), F.col("note_doc").alias("doc"), note_base.alias("base"), "place").unionByName(
        backed.where(own_id("ref").isNull()).select(F.col("ref").alias("key"), F.col("ref_book").alias("book"), F.col("ref_doc").alias("doc"), ref_base.alias("base"), "place")
    )
    wants = wants.groupBy("key", *KEY).agg(F.min_by("base", "place").alias("base"), F.min("place").alias("place"))
    used = pub.elements.where(attr("id").isNotNull()).select(*KEY, F.concat_ws("|", *KEY, "eid").alias("key"), attr("id").alias("id")).join(gone, "key", "left_anti")
    ids = cut(allot_ids(wants, used))
    id_of = lambda side: F.coalesce(own_id(side), F.col(f"{side}_new"))
    with_ids = lambda df: df.join(ids.select(F.col("key").alias("ref"), F.col("id").alias("ref_new")), "ref", "left").join(ids.select(F.col("key").alias("note"), F.col("id").alias("note_new")), "note", "left")
    linked, backed = cut(with_ids(linked)), cut(with_ids(backed))
    # a reference that isn't an anchor is wrapped once, with all that its new anchor gets
    href = relative(F.col("ref_doc"), F.col("note_doc"), id_of("note"))
    links_of = linked.groupBy("ref").agg(F.max_by(href, "place").alias("href"))
    touched = linked.select("ref").union(backed.select("ref")).union(rows.where("kind = 'mark' and value = 'noteref'").select("note")).distinct()
    refs = touched.join(links_of, "ref", "left").join(ids.select(F.col("key").alias("ref"), F.col("id").alias("anchor_id")), "ref", "left").join(at("ref"), "ref")
    refs = cut(refs)
    anchors, bare = refs.where(anchored("ref")), refs.where(~anchored("ref"))
    # types: what the last mark and all unmarks leave; references have theirs from above
    final = rows.where("kind in ('mark', 'unmark')").groupBy("note").agg(
        F.max_by(F.when(F.col("kind") == "mark", F.col("value")), F.when(F.col("kind") == "mark", F.struct("batched", "nth"))).alias("marked"), F.bool_or(F.col("batched") & (F.col("kind") == "mark")).alias("late"),
        F.collect_set(F.when(F.col("kind") == "unmark", F.col("value"))).alias("unmarked"), F.first("type").alias("type"),
    ).join(refs.select(F.col("ref").alias("note")), "note", "left_anti").join(at("note"), "note")
    final = final.where("not (late and type is not null and size(unmarked) = 0)")  # a batch's note that is declared stays as it is
    left = F.filter(types("note"), lambda t: ~F.array_contains("unmarked", t))
    stays = F.when(F.col("marked").isNotNull() & (F.col("late") | ~F.array_contains("unmarked", F.col("marked"))), F.col("marked"))
    bare_type = F.when(F.col("marked").isNotNull(), others("note")).otherwise(left)
    new_type = F.when(stays.isNotNull(), whole_type("note", stays)).otherwise(F.nullif(F.array_join(F.array_sort(bare_type), " "), F.lit("")))
    had_role = F.lower(F.trim(F.try_element_at("note_attrs", F.lit("role"))))
    drops = F.col("marked").isNotNull() | F.arrays_overlap(F.array(had_role), F.transform("unmarked", role_of))
    # ways back: of a pair the last row holds; what is there already is put in again only if it was taken away
    there = graph.backlinks.where("ref is not null").select(*KEY, "note", "ref", "eid").join(elements.select(*KEY, "eid", "path", "parent"), [*KEY, "eid"])
    holders = elements.where((F.col("tag") == "p") & F.array_contains(F.split(F.coalesce(attr("class"), F.lit("")), " +"), "note-backlink")).select(*KEY, F.col("eid").alias("parent"), F.col("path").alias("holder"))
    there = cut(there.join(holders, [*KEY, "parent"], "left").select(*KEY, "note", "ref", F.coalesce("holder", "path").alias("back_path")))
    final_back = backed.groupBy("note", "ref").agg(F.max_by(F.struct("kind", "label", "place", "ref_book", "ref_doc", "ref_attrs", "ref_new", "note_book", "note_doc", "note_path", "note_tag"), F.struct("place", "kind")).alias("r"), F.bool_or(F.col("kind") == "unback").alias("taken"))
    final_back = cut(final_back.join(there.select("note", "ref").distinct().withColumn("had", F.lit(True)), ["note", "ref"], "left").select("note", "ref", "taken", "had", "r.*"))
    new_backs = final_back.where("kind = 'backlink' and (had is null or taken)")
    taken_backs = there.join(final_back.where("taken and had").select("note", "ref"), ["note", "ref"])
    anchor = F.concat(F.lit('<a class="note-backlink" role="doc-backlink" href="'), escaped(relative(F.col("note_doc"), F.col("ref_doc"), id_of("ref"))), F.lit('">'), escaped(F.coalesce("label", F.lit("back"))), F.lit("</a>"))
    back = F.when(F.col("note_tag") == "li", F.concat(F.lit(" "), anchor)).otherwise(F.concat(F.lit('<p class="note-backlink">'), anchor, F.lit("</p>")))
    appended = new_backs.groupBy("note_book", "note_doc", "note_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "ref", back.alias("b")))), lambda x: x["b"]), "").alias("value"))
    unlinked = rows.where("kind = 'unlink'").where(anchored("ref")).join(links_of.select("ref"), "ref", "left_anti").join(lost("ref").select("ref"), "ref", "left_anti")
    parts = [
        edit(unlinked, "ref", "href", none),
        edit(rows.where("kind = 'delete'"), "note", "remove", F.lit("")),
        edit(final, "note", "epub:type", new_type), edit(final.where(drops), "note", "role", role_of(stays)),
        edit(anchors, "ref", "epub:type", whole_type("ref", F.lit("noteref"))), edit(anchors, "ref", "role", F.lit(ROLES["noteref"])),
        edit(anchors.where("href is not null"), "ref", "href", F.col("href")), edit(anchors.where("anchor_id is not null"), "ref", "id", F.col("anchor_id")),
        edit(bare, "ref", "wrap", wrapped(F.when(F.col("href").isNotNull(), F.concat(F.lit(' href="'), escaped(F.col("href")), F.lit('"'))).otherwise(""), F.when(F.col("anchor_id").isNotNull(), F.concat(F.lit(' id="'), escaped(F.col("anchor_id")), F.lit('"'))).otherwise(""))),
        edit(linked.where("note_new is not null").dropDuplicates(["note"]), "note", "id", F.col("note_new")),
        appended.select(F.col("note_book").alias("book"), F.col("note_doc").alias("doc"), F.col("note_path").alias("path"), F.lit("append").alias("name"), "value"),
        taken_backs.select(*KEY, F.col("back_path").alias("path"), F.lit("remove").alias("name"), F.lit("").alias("value")),
    ]
    return cut(reduce(DataFrame.unionByName, parts).distinct()), refused


def inverse_of(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits (of attributes) that undo edits: each name's value before, null where it was absent.

    Edits of structure have no such inverse and are an error; `operators.versions` takes back those as well.
    """
    others = [r[0] for r in edits.where(~F.col("name").isin(*EDITABLE)).select("name").distinct().limit(20).collect()]
    if others:
        raise ValueError(f"no edits of attributes undo {', '.join(sorted(others))}; record the change as versions of its documents")
    before = elements.select(*KEY, "path", "tag", "attrs")
    old = F.when(F.col("name") == "tag", F.col("tag")).when(F.col("name") == "heading_level", F.substring("tag", 2, 1)).otherwise(F.try_element_at("attrs", F.col("name")))
    return edits.select(*EDIT[:4]).join(before, [*KEY, "path"]).select(*EDIT[:4], old.alias("value"))


def append_change(path: str, inverse: DataFrame, kind: str, summary: str) -> int:
    """Adds one change of each book to the stored log, as one commit: (book, id, at, kind, summary, inverse). at is in whole seconds; inverse is JSON.

    The commit's number is the changes' id, so that of two writers at once each has its own. Log rows are never rewritten; an undo is a row of kind `undo`.
    """
    packed = inverse.groupBy("book").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*EDIT)))).alias("inverse"))
    run = new_run()
    write_part(packed.select("book", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.lit(kind).alias("kind"), F.lit(summary).alias("summary"), "inverse"), path, "log", run)
    return commit(inverse.sparkSession, path, run)


LOG = "book string, at string, kind string, summary string, inverse string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The stored log (book, id, at, kind, summary, inverse); an absent one is empty."""
    return committed(spark, path, "log", LOG).select("book", F.col("commit").alias("id"), "at", "kind", "summary", "inverse")


def last_inverse(log: DataFrame) -> DataFrame:
    """The edits that take back each book's newest change that isn't undone."""
    open_changes = apply_undo(log, ["book"], "id", "kind").where("kind <> 'undo' and not undone")
    newest = open_changes.groupBy("book").agg(F.max_by("inverse", "id").alias("inverse"))
    return newest.select(F.explode(F.from_json("inverse", INVERSE)).alias("e")).select("e.*")
