"""Operators that match rows of one table with rows of another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of left without a match in right."""
    return left.join(right.select(*on), list(on), "left_anti")


def covered_by_first(items: DataFrame, explicit: DataFrame, wholes: DataFrame, key: str, group: str, order: Sequence) -> DataFrame:
    """Items that neither an explicit entry names nor, being the first of their group, an entry for the whole group."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(*order)) == 1
    marked = items.withColumn("_first", first)
    named = marked.join(explicit.select(key).distinct(), key, "left_anti")
    held = wholes.select(F.col(group).alias("_group")).distinct()
    joined = named.join(held, F.col(group) == F.col("_group"), "left")
    return joined.where(~(F.col("_first") & F.col("_group").isNotNull())).drop("_first", "_group")


def first_by(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def resolve_status(refs: DataFrame, targets: DataFrame, ref_key: str, target_key: str, good: Column, fallback: str | None = None) -> DataFrame:
    """Adds status: none (null reference), missing, inner (the target's `fallback` is set), target, or other.

    good: whether a target is of the wanted kind. `fallback`: a column of targets that names what it lies in.
    """
    known = targets.select(F.col(target_key).alias("_key"), good.alias("_good"), (F.col(fallback) if fallback else F.lit(None).cast("string")).alias("_inner"), F.lit(True).alias("_found"))
    joined = refs.join(known, F.col(ref_key) == F.col("_key"), "left")
    status = (
        F.when(F.col(ref_key).isNull(), "none").when(F.col("_found").isNull(), "missing").when(F.col("_good"), "target")
        .when(F.col("_inner").isNotNull(), "inner").otherwise("other")
    )
    return joined.withColumn("status", status).drop("_key", "_good", "_inner", "_found")


def missing_back(edges: DataFrame, backs: DataFrame, a: str, b: str) -> DataFrame:
    """Edges (a, b) without a back edge (b, a) among backs."""
    turned = backs.select(F.col(a).alias("_b"), F.col(b).alias("_a"))
    return edges.join(turned, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left_anti")


def unique_pair(refs: DataFrame, tiers: Sequence[DataFrame], key: str, target: str) -> DataFrame:
    """Adds target and tier: the only candidate of the first tier that has exactly one; rows without any have nulls."""
    out, names = refs, []
    for i, tier in enumerate(tiers):
        one = tier.groupBy(F.col(key).alias(f"_k{i}")).agg(F.count("*").alias("_n"), F.min(target).alias(f"_t{i}")).where("_n = 1").drop("_n")
        out = out.join(one, F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        names.append(f"_t{i}")
    tier = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(i)) for i, n in enumerate(names)])
    return out.withColumns({target: F.coalesce(*names), "tier": tier}).drop(*names)


def interval_cover(points: DataFrame, spans: DataFrame, on: Sequence[str], point: Column, begin: Column, end: Column, how: str = "inner") -> DataFrame:
    """Pairs of a point and a span of equal key with begin < point <= end; an equi join with a range beside it."""
    condition = (point > begin) & (point <= end)
    for c in on:
        condition = condition & (points[c] == spans[c])
    joined = points.join(spans, condition, how)
    for c in on:
        joined = joined.drop(spans[c])
    return joined


def duplicate_numbers(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """Members of a key that several rows share, but the first; adds members."""
    w = Window.partitionBy(*key)
    return df.withColumns({"members": F.count("*").over(w), "_n": F.row_number().over(w.orderBy(*order))}).where("members > 1 and _n > 1").drop("_n")


def multi_referenced(refs: DataFrame, target: str, order: Sequence[str], mark: str, more_than: int = 1) -> DataFrame:
    """(target, incoming, marks): targets of more than so many references, with their marks in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(mark).alias("_mark"))))
    return refs.groupBy(target).agg(F.count("*").alias("incoming"), listed.alias("_m")).where(F.col("incoming") > more_than).select(
        target, "incoming", F.array_join(F.transform("_m", lambda m: m["_mark"].cast("string")), ",").alias("marks")
    )


def bag_difference(before: DataFrame, after: DataFrame, key: Sequence[str], item: str) -> DataFrame:
    """(key, item, lost): how many more times before has an item than after; one shuffle of partial counts, no row per copy."""
    counts = before.select(*key, item, F.lit(1).alias("_n")).unionByName(after.select(*key, item, F.lit(-1).alias("_n")))
    return counts.groupBy(*key, item).agg(F.sum("_n").alias("lost")).where("lost > 0")


def grid_slots(cells: DataFrame, row: str, col: str, rowspan: str, colspan: str) -> DataFrame:
    """A row for each slot that a cell covers; adds slot_row and slot_col."""
    down = F.explode(F.sequence(F.col(row), F.col(row) + F.col(rowspan) - 1))
    right = F.explode(F.sequence(F.col(col), F.col(col) + F.col(colspan) - 1))
    return cells.select("*", down.alias("slot_row")).select("*", right.alias("slot_col"))
