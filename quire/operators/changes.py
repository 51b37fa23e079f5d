"""The change log, edits as changes of rows, and replaced partitions.

An edit is data: rows that say which attribute of which element becomes what. State is the fold of the changes that
aren't undone, so that applying and undoing are joins and windows over the log, not steps of a program.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_active(log: DataFrame, key: Sequence[str], order: str, active: Column) -> DataFrame:
    """The newest active row of each key, summed up before the shuffle."""
    rest = [c for c in log.columns if c not in key]
    return log.where(active).groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def apply_undo(log: DataFrame, key: Sequence[str], order: str, kind: str) -> DataFrame:
    """Adds undone: a row of kind `undo` takes back the newest change before it that isn't undone; strictly last in, first out.

    Counting changes up and undos down gives each change its height; the first undo that falls below it takes it back.
    """
    w = Window.partitionBy(*key).orderBy(order)
    step = F.when(F.col(kind) == "undo", -1).otherwise(1)
    height = log.withColumn("_h", F.sum(step).over(w))
    # an undo without anything to undo doesn't count: heights are measured from the lowest so far
    floor = F.least(F.lit(0), F.min("_h").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lifted = height.withColumn("_h", F.col("_h") - floor)
    # a change to height h and the undo from h share a level, and alternate on it
    level = lifted.withColumn("_level", F.when(F.col(kind) == "undo", F.col("_h") + 1).otherwise(F.col("_h")))
    following = F.lead(kind).over(Window.partitionBy(*key, "_level").orderBy(order))
    return level.withColumn("undone", (F.col(kind) != "undo") & F.coalesce(following == "undo", F.lit(False))).drop("_h", "_level")


def replace_rows(old: DataFrame, new: DataFrame, key: Sequence[str], scope: DataFrame | None = None) -> DataFrame:
    """old without the rows of the keys in scope (of new, by default), and new."""
    gone = (new if scope is None else scope).select(*key).distinct()
    return old.join(gone, list(key), "left_anti").unionByName(new)


#: Attributes that an edit may set; heading_level and tag change the element itself.
EDITABLE = ("tag", "alt", "lang", "epub:type", "heading_level", "id", "href", "scope", "headers", "start", "value", "role")


def set_attributes(elements: DataFrame, edits: DataFrame, key: Sequence[str] = ("book", "doc", "path")) -> tuple[DataFrame, DataFrame]:
    """(elements with the edits applied, edits that can't be: of unknown elements or attributes, with the reason).

    edits: key, name, value; a null value removes the attribute. Of several edits of one attribute the largest value wins.
    """
    pairs = F.array(*[F.lit(x) for x in ("ul>ol", "ol>ul", "td>th", "th>td")])
    known = elements.select(*key, "tag").withColumnsRenamed({"tag": "_tag"}).withColumn("_known", F.lit(True)).distinct()
    judged = edits.join(known, list(key), "left").withColumn(
        "reason", F.when(~F.col("name").isin(*EDITABLE), "attribute").when(F.col("_known").isNull(), "element").when((F.col("name") == "heading_level") & ~F.coalesce(F.col("value").rlike("^[1-6]$"), F.lit(False)), "value")
        .when((F.col("name") == "tag") & ~F.coalesce(F.array_contains(pairs, F.concat_ws(">", "_tag", "value")), F.lit(False)), "value"),
    )
    bad = judged.where("reason is not null").select(*edits.columns, "reason")
    # an element with a bad edit gets none of its edits
    good = judged.where("reason is null").join(bad.select(*key).distinct(), list(key), "left_anti").groupBy(*key, "name").agg(F.max("value").alias("value"))
    made = good.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("name", F.coalesce("value", F.lit("\x00"))))).alias("_set"))
    level = F.try_element_at("_set", F.lit("heading_level"))
    attrs = F.map_filter(F.map_concat(F.map_filter("attrs", lambda k, v: ~F.map_contains_key("_set", k)), F.map_filter("_set", lambda k, v: ~k.isin("heading_level", "tag"))), lambda k, v: v != "\x00")
    joined = elements.join(made, list(key), "left")
    changed = joined.withColumns({"attrs": F.when(F.col("_set").isNull(), F.col("attrs")).otherwise(attrs), "tag": F.when(level.isNotNull() & F.col("tag").rlike("^h[1-6]$"), F.concat(F.lit("h"), level)).otherwise(F.coalesce(F.try_element_at("_set", F.lit("tag")), F.col("tag")))})
    return changed.select(*elements.columns), bad


def reorder(items: DataFrame, order: DataFrame, group: Sequence[str], item: str, position: str) -> tuple[DataFrame, DataFrame]:
    """(items at their new positions, groups whose order doesn't name just their items); the latter keep theirs."""
    mine = items.groupBy(*group).agg(F.array_sort(F.collect_set(item)).alias("_a"))
    given = order.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_b"))
    bad = given.join(mine, list(group), "left").where(~F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).select(*group)
    good = order.join(bad, list(group), "left_anti").select(*group, item, F.col(position).alias("_p"))
    moved = items.join(good, [*group, item], "left").withColumn(position, F.coalesce("_p", position)).select(*items.columns)
    return moved, bad


def new_only(after: DataFrame, before: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of after whose key before lacks: what an edit brought in."""
    return after.join(before.select(*key).distinct(), list(key), "left_anti")
