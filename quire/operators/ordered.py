"""Order-sensitive operators: columns in, DataFrame out. `order` must be a total order within its group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(group: Sequence[str], order: Sequence) -> Window:
    return Window.partitionBy(*group).orderBy(*order)


def jumps(df: DataFrame, group: Sequence[str], order: Sequence, level: str, step: int = 1) -> DataFrame:
    """Rows whose level is more than `step` above the row's before; adds previous. The first of a group is free."""
    out = df.withColumn("previous", F.lag(level).over(_window(group, order)))
    return out.where(F.col(level) > F.col("previous") + step)


def order_conflicts(df: DataFrame, group: Sequence[str], order: Sequence, position: str) -> DataFrame:
    """(group, conflict): whether positions fall somewhere in the group; equal ones are fine."""
    falls = df.withColumn("_falls", F.lag(position).over(_window(group, order)) > F.col(position))
    return falls.groupBy(*group).agg(F.coalesce(F.bool_or("_falls"), F.lit(False)).alias("conflict"))


def after_first(df: DataFrame, key: Sequence[str], order: Sequence, show: str) -> DataFrame:
    """Rows of a key but the first; adds occurrence (2, 3, ...) and first, the first row's `show`."""
    w = _window(key, order)
    out = df.withColumns({"occurrence": F.row_number().over(w), "first": F.first(show).over(w)})
    return out.where("occurrence > 1")


def running_ordinal(df: DataFrame, group: Sequence[str], order: Sequence, value: Column, start: Column, name: str = "ordinal") -> DataFrame:
    """Adds the running number of an ordered list: from start, set anew by a non-null value, one more for each row."""
    w = _window(group, order)
    place = F.row_number().over(w) - 1
    known = df.withColumns({"_place": place, "_value": value})
    anchor = F.last(F.when(F.col("_value").isNotNull(), F.col("_value") - F.col("_place")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return known.withColumn(name, F.col("_place") + F.coalesce(anchor, start)).drop("_place", "_value")


def adjacent_same(df: DataFrame, group: Sequence[str], order: Sequence, kind: str, kinds: Sequence[str], between: Sequence[str]) -> DataFrame:
    """Rows of `kinds` that the same kind follows at once, or after one row of `between`; adds relation: split or interrupted."""
    w = _window(group, order)
    one, two = F.lead(kind, 1).over(w), F.lead(kind, 2).over(w)
    relation = F.when(one == F.col(kind), F.lit("split")).when(one.isin(*between) & (two == F.col(kind)), F.lit("interrupted"))
    return df.withColumn("relation", relation).where(F.col(kind).isin(*kinds) & F.col("relation").isNotNull())


def islands(df: DataFrame, group: Sequence[str], order: Sequence, breaks: Column, least: int = 2) -> DataFrame:
    """Adds run, the number of a run of neighbours in its group, and run_length; keeps runs of `least` rows or more.

    breaks: whether a row begins a run; it may use the columns `lag_<name>`, the values of the row before.
    """
    w = _window(group, order)
    lagged = df.withColumns({f"lag_{c}": F.lag(c).over(w) for c in df.columns})
    runs = lagged.withColumn("run", F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sized = runs.withColumn("run_length", F.count("*").over(Window.partitionBy(*group, "run")))
    return sized.where(F.col("run_length") >= least).drop(*[f"lag_{c}" for c in df.columns])


def indent_levels(df: DataFrame, group: Sequence[str], indent: str, name: str = "level") -> DataFrame:
    """Adds the level of an indent: in steps of the smallest positive indent or gap between indents, halves to even."""
    distinct = df.select(*group, indent).distinct()
    gap = F.col(indent) - F.lag(indent).over(_window(group, [indent]))
    steps = distinct.withColumn("_gap", gap).groupBy(*group).agg(
        F.least(F.min(F.when(F.col(indent) > 0, F.col(indent))), F.min(F.when(F.col("_gap") > 0, F.col("_gap")))).alias("_step")
    )
    joined = df.join(steps, list(group))
    return joined.withColumn(name, F.coalesce(F.bround(F.col(indent) / F.col("_step")), F.lit(0)).cast("int")).drop("_step")


def level_breaks(df: DataFrame, group: Sequence[str], order: Sequence, level: str, most: int = 1) -> DataFrame:
    """Rows whose level differs from the row's before by more than `most`; adds previous."""
    out = df.withColumn("previous", F.lag(level).over(_window(group, order)))
    return out.where(F.abs(F.col(level) - F.col("previous")) > most)


def top_rows(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def narration(parts: Sequence[DataFrame], group: Sequence[str], order: Sequence) -> DataFrame:
    """One ordered list of lines from several kinds of lines; adds line, from 1 on in each group."""
    lines = parts[0]
    for more in parts[1:]:
        lines = lines.unionByName(more)
    return lines.withColumn("line", F.row_number().over(_window(group, order)))
