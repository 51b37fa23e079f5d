"""Edits of structure on rows: the elements of a document as they will be, without writing or parsing it.

Elements that go, come or are wrapped change the numbers of all that follow. Each element, old or new, gets a place that compares as its start tag
lies in the edited markup; numbers are ranks of places, and what depends on others (paths, last descendants, texts) follows by joins
of elements to those above them. Only the markup that the edits bring is parsed. A document's ranks are one window; documents without edits aren't shuffled
for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.changes import set_attributes
from quire.operators.lineage import stored
from quire.plans.model import KEY
from quire.sources.markup import ELEMENTS, SILENT, TEXT, WHOLE, shred, shred_runs

#: Names of edits that change structure, as in `markup.Rewriter`.
STRUCTURAL = ("remove", "wrap", "before", "append", "text")
#: White space as Python's strip takes it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
ORDER = ("at", "slot", "depth", "side", "inner", "run", "ord")


def place(*parts: Column | int) -> Column:
    """Where something begins: `at` an old element's number, in front of it (slot 0), as its wrapper (1), itself or its new text (2), or after it (3), there the deepest end tags first."""
    return F.struct(*[(F.lit(p) if isinstance(p, int) else p).cast("int").alias(n) for n, p in zip(ORDER, parts, strict=True)])


def numbers(chain: str) -> Column:
    return F.transform(F.filter(F.split(chain, " "), lambda x: x != ""), lambda x: x.cast("int"))


def judge(elements: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row of marks for each edited element, edits that can't be); an element with a bad edit gets none."""
    known = elements.select(*KEY, "path", "eid", "last", "depth", "chain")
    reason = F.when(~F.col("name").isin(*STRUCTURAL), "name").when(F.col("eid").isNull(), "element").when((F.col("name") == "wrap") & ~F.coalesce(F.col("value").rlike(r"^[A-Za-z]"), F.lit(False)), "value")
    judged = edits.join(known, [*KEY, "path"], "left").withColumn("reason", reason)
    bad = judged.where("reason is not null").select(*edits.columns, "reason")
    good = judged.where("reason is null").join(bad.select(*KEY, "path").distinct(), [*KEY, "path"], "left_anti").where("value is not null or name = 'remove'")
    return good.groupBy(*KEY, "eid").agg(*[F.max(F.when(F.col("name") == x, F.coalesce("value", F.lit("")))).alias(f"_{x}") for x in STRUCTURAL]), bad


def survivors(elements: DataFrame, marks: DataFrame) -> DataFrame:
    """The old elements that stay, with their marks and `ups`, the names of all above them: o and a number for old ones, w and a number for wrappers."""
    above = elements.select(*KEY, "eid", F.explode(numbers("chain")).alias("up"))
    lasting = marks.where("_remove is not null or _text is not null or _wrap is not null").select(*KEY, F.col("eid").alias("up"), (F.col("_remove").isNotNull() | F.col("_text").isNotNull()).alias("_ends"), F.col("_wrap").isNotNull().alias("_wraps"))
    met = above.join(lasting, [*KEY, "up"]).groupBy(*KEY, "eid").agg(F.bool_or("_ends").alias("_gone"), F.collect_set(F.when(F.col("_wraps"), F.col("up"))).alias("_wrapped"))
    name = lambda kind, x: F.concat(F.lit(kind), x.cast("string"))
    ups = F.flatten(F.transform(numbers("chain"), lambda x: F.when(F.coalesce(F.array_contains("_wrapped", x), F.lit(False)), F.array(name("w", x), name("o", x))).otherwise(F.array(name("o", x)))))
    kept = elements.join(met, [*KEY, "eid"], "left").join(marks, [*KEY, "eid"], "left").where("not coalesce(_gone, false) and _remove is null").withColumn("ups", ups)
    own = F.when(F.col("_wrap").isNotNull(), F.concat("ups", F.array(name("w", F.col("eid"))))).otherwise(F.col("ups"))
    return kept.select(*KEY, "eid", "last", "depth", "tag", "attrs", "ups", own.alias("own"), "_wrap", "_before", "_append", "_text")


def brought(live: DataFrame, soup: bool, most: int, whole: frozenset) -> tuple[DataFrame, DataFrame]:
    """(elements, texts) of the markup that edits bring, with places and ups; the name of one is its kind (w, b, a), its target and its number."""
    part = lambda kind, markup, some: F.when(some, F.struct(F.lit(kind).alias("kind"), markup.alias("markup")))
    wrap, no_text = F.col("_wrap"), F.col("_text").isNull()
    parts = F.array_compact(F.array(
        part("w", F.concat(F.lit("<"), wrap, F.lit("></"), F.regexp_extract("_wrap", r"^\S+", 0), F.lit(">")), wrap.isNotNull()), part("b", F.col("_before"), F.col("_before").isNotNull()), part("a", F.col("_append"), F.col("_append").isNotNull() & no_text),
    ))
    given = live.where("coalesce(_wrap, _before, _append) is not null").select(*KEY, "eid", F.explode(parts).alias("p"))
    docs = given.select("book", F.concat_ws("\n", F.col("eid").cast("string"), "p.kind", "doc").alias("doc"), F.col("p.markup").alias("text"))
    said = F.split("doc", "\n", 3)

    def back(df: DataFrame) -> DataFrame:
        renamed = df.withColumns({"target": said[0].cast("int"), "kind": said[1], "doc": said[2]})
        host = live.select(*KEY, F.col("eid").alias("target"), "last", F.col("depth").alias("deep"), "ups", F.concat("own", F.array(F.concat(F.lit("o"), F.col("eid").cast("string")))).alias("within"))
        return renamed.join(host, [*KEY, "target"])

    stem = F.concat("kind", F.col("target").cast("string"))
    inner = lambda x: F.concat(stem, F.lit("."), x.cast("string"))
    base = F.when(F.col("kind") == "a", F.col("within")).otherwise(F.col("ups"))

    def at(first: Column | int, run: int, nth: Column | int) -> Column:
        return F.when(F.col("kind") == "w", place(F.col("target"), 1, 0, 0, 0, 0, 0)).when(F.col("kind") == "b", place(F.col("target"), 0, 0, 0, first, run, nth)).otherwise(place(F.col("last"), 3, -F.col("deep"), 1, first, run, nth))

    found = back(shred(docs, "book", "doc", "text", soup, most, whole).select(*KEY, "eid", "tag", "attrs", "chain")).where("kind <> 'w' or eid = 0")
    elements = found.select(*KEY, F.when(F.col("kind") == "w", stem).otherwise(inner(F.col("eid"))).alias("id"), F.concat(base, F.transform(numbers("chain"), inner)).alias("ups"), at(F.col("eid"), 0, 0).alias("order"), "tag", "attrs")
    chains = found.select(*KEY, "target", "kind", F.col("eid").alias("up"), F.concat(numbers("chain"), F.array("eid")).alias("line"))
    runs = back(shred_runs(docs, "book", "doc", "text", soup)).where("kind <> 'w'").join(chains, [*KEY, "target", "kind", "up"], "left")
    line = F.coalesce("line", F.array().cast("array<int>"))
    texts = runs.select(*KEY, F.concat(base, F.transform(line, inner)).alias("ups"), at(F.col("at"), 1, F.col("ord")).alias("order"), F.lit(False).alias("old"), "data")
    return elements, texts


def restructure(elements: DataFrame, runs: DataFrame, edits: DataFrame, soup: bool = False, most: int = TEXT, whole: frozenset = WHOLE) -> tuple[DataFrame, DataFrame]:
    """(elements after the edits, edits that can't be, with the reason): as `shred` gives the rewritten markup.

    elements, runs: of `shred` and `shred_runs` (soup, most and whole as there); edits (book, doc, path, name, value) with a name of STRUCTURAL. Of several of one element
    and name the largest value counts. Edits within what is removed or gets a new text fall away; an `append` beside a `text` too. `before` and
    `append` hold whole markup. An element without end tag takes no `text` and no `append`. Elements without books or documents, and documents without edits, stay as they are.
    """
    marks, bad = judge(elements, edits)
    marks = stored(marks)
    names = [x.split()[0] for x in ELEMENTS.split(", ")]
    edited = marks.select(*KEY).distinct()
    rest = elements.join(edited, KEY, "left_anti").select(*names)
    live = stored(survivors(elements.join(edited, KEY, "left_semi"), marks))
    old_name = F.concat(F.lit("o"), F.col("eid").cast("string"))
    within = F.concat("own", F.array(old_name))
    new_elements, new_texts = brought(live, soup, most, whole)
    kept = live.select(*KEY, old_name.alias("id"), F.col("own").alias("ups"), place(F.col("eid"), 2, 0, 0, 0, 0, 0).alias("order"), "tag", "attrs")
    hosts = live.where("_text is null").select(*KEY, F.col("eid").alias("up"), within.alias("ups"), F.col("depth").alias("deep"))
    texts = runs.join(hosts, [*KEY, "up"]).select(*KEY, "ups", place(F.col("at"), 3, -F.col("deep"), 0, 0, 1, F.col("ord")).alias("order"), F.lit(True).alias("old"), "data")
    put = live.where((F.col("_text") != "") & ~F.col("tag").isin(*SILENT)).select(*KEY, within.alias("ups"), place(F.col("eid"), 2, 1, 0, 0, 1, 0).alias("order"), F.lit(False).alias("old"), F.col("_text").alias("data"))
    both = kept.unionByName(new_elements).unionByName(texts.unionByName(new_texts).unionByName(put), allowMissingColumns=True)

    w = Window.partitionBy(*KEY).orderBy("order")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumns({"up_id": F.try_element_at("ups", F.lit(-1)), "is_run": F.col("id").isNull()})
    placed = placed.withColumns({"eid": (F.sum(F.when(F.col("is_run"), 0).otherwise(1)).over(sofar) - 1).cast("int"), "_p": F.lag(F.struct("up_id", "old", "order", "data")).over(w)})
    # texts that nothing parts any more are one; those that were apart with nothing between (a stray `<`) stay so
    apart = F.col("old") & F.col("_p.old") & (F.col("order.at") == F.col("_p.order.at"))
    joins = F.col("data").isNotNull() & F.col("_p.data").isNotNull() & F.col("up_id").eqNullSafe(F.col("_p.up_id")) & ~apart
    placed = stored(placed.withColumn("part", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(sofar)).drop("_p"))

    siblings = Window.partitionBy(*KEY, "up_id").orderBy("eid")
    els = placed.where("not is_run").select(*KEY, "id", "up_id", "ups", "eid", "order", "tag", "attrs")
    els = els.withColumns({"nth": F.row_number().over(Window.partitionBy(*KEY, "up_id", "tag").orderBy("eid")), "child": F.row_number().over(siblings) - 1})
    els = els.withColumn("step", F.format_string("%s[%d]", "tag", "nth"))
    spots = els.select(*KEY, F.col("id").alias("up_id"), F.col("eid").alias("up"), F.col("tag").alias("up_tag"), "step")
    above = els.select(*KEY, "eid", F.explode("ups").alias("up_id")).join(spots, [*KEY, "up_id"])
    largest = lambda tag: F.max(F.when(F.col("up_tag") == tag, F.col("up")))
    facts = above.groupBy(*KEY, "eid").agg(
        F.max("up").alias("parent"), F.count("*").cast("int").alias("depth"), F.array_sort(F.collect_list(F.struct("up", "step"))).alias("_above"), F.bool_or(F.col("up_tag") == "nav").alias("in_nav"), largest("a").alias("anchor"), largest("table").alias("table_eid"),
    )
    lasts = above.groupBy(*KEY, F.col("up").alias("eid")).agg(F.max("eid").alias("last"))

    merged = placed.where("data is not null").groupBy(*KEY, "part").agg(F.min("order").alias("order"), F.first("ups").alias("ups"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "data"))), lambda x: x["data"]), "").alias("data"))
    said = merged.select(*KEY, "order", "data", F.explode("ups").alias("up_id")).join(spots.drop("step"), [*KEY, "up_id"])
    breaks = els.where("tag = 'br'").select(*KEY, "order", F.lit(None).cast("string").alias("data"), "up_id").join(spots.where("up_tag = 'p'").drop("step"), [*KEY, "up_id"])
    stripped = lambda c: F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")
    part = stripped(F.col("data"))
    spoken = said.unionByName(breaks).groupBy(*KEY, F.col("up").alias("eid")).agg(
        F.array_sort(F.collect_list(F.when(part != "", F.struct("order", part.alias("data"))))).alias("_parts"),
        F.array_sort(F.collect_list(F.when(F.col("up_tag") == "p", F.struct("order", F.coalesce("data", F.lit("\0")).alias("data"))))).alias("_events"), F.bool_or(F.col("data").isNull()).alias("_broken"),
    )
    told = lambda c, between: F.coalesce(F.array_join(F.transform(c, lambda x: x["data"]), between), F.lit(""))
    bounded = lambda c: F.when(F.col("tag").isin(*whole), c).otherwise(F.substring(c, 1, most))
    joined = els.join(facts, [*KEY, "eid"], "left").join(lasts, [*KEY, "eid"], "left").join(spoken, [*KEY, "eid"], "left")
    made = joined.withColumns({
        "last": F.coalesce("last", "eid"), "depth": F.coalesce("depth", F.lit(0)), "in_nav": F.coalesce("in_nav", F.lit(False)),
        "path": F.concat_ws("/", F.transform("_above", lambda x: x["step"]), "step"), "chain": F.coalesce(F.array_join(F.transform("_above", lambda x: F.concat(F.lit(" "), x["up"].cast("string"))), ""), F.lit("")),
        "text": bounded(told("_parts", " ")), "joined": bounded(told("_parts", "")),
        "lines": F.when(F.col("_broken"), F.transform(F.split(told("_events", ""), "\0"), stripped)),
    })
    return rest.unionByName(made.select(*names)), bad


def preview(elements: DataFrame, runs: DataFrame, edits: DataFrame, soup: bool = False) -> tuple[DataFrame, DataFrame]:
    """(elements, edits that can't be): all edits of `markup.rewrite_entries`, of attributes as well as structure, before anything is written."""
    structural = F.col("name").isin(*STRUCTURAL)
    changed, bad = set_attributes(elements, edits.where(~structural))
    shaped, worse = restructure(changed, runs, edits.where(structural), soup)
    return shaped, bad.unionByName(worse)
