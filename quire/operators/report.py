"""Reports of findings and of the change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups(findings: DataFrame, key: Sequence[str]) -> DataFrame:
    return findings.groupBy(*key).agg(F.count("*").alias("n"))


def escaped(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


#: Rows of a table in one part of a report.
PART_ROWS = 1000


def html_report(findings: DataFrame, book: str, check: str, columns: Sequence[str], order: Sequence[str], rows: int = PART_ROWS) -> DataFrame:
    """(book, check, part, n, html): tables of at most `rows` findings, numbered from 0; values are escaped. n is the check's count.

    A book's page is its parts in order of check and part; its first parts have the heading. No group is put together whole.
    """
    cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in columns], F.lit("</tr>"))
    of = Window.partitionBy(F.col(book), F.col(check)).orderBy(*order, "_row")
    numbered = findings.withColumn("_row", cells).select(F.col(book).alias("book"), F.col(check).alias("check"), "_row", F.floor((F.row_number().over(of) - 1) / rows).cast("int").alias("part"), F.row_number().over(of).alias("_nth"))
    parts = numbered.groupBy("book", "check", "part").agg(F.array_sort(F.collect_list(F.struct("_nth", "_row"))).alias("_rows"))
    counts = findings.groupBy(F.col(book).alias("_b"), F.col(check).alias("_c")).agg(F.count("*").alias("n"))
    joined = parts.join(counts, F.col("book").eqNullSafe(F.col("_b")) & F.col("check").eqNullSafe(F.col("_c")))
    head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    title = F.when(F.col("part") == 0, F.concat(F.lit("<h2>"), escaped(F.col("book")), F.lit(": "), escaped(F.col("check")), F.lit(" ("), F.col("n").cast("string"), F.lit(")</h2>"))).otherwise("")
    html = F.concat(title, F.lit(head), F.array_join(F.transform("_rows", lambda r: r["_row"]), ""), F.lit("</table>"))
    return joined.select("book", "check", "part", "n", html.alias("html"))


def write_changes(log: DataFrame, path: str, columns: Sequence[str], order: str, labels: dict[str, str], kind: str = "kind", limit: int = 10_000) -> None:
    """The newest `limit` changes as CSV, oldest first, kinds by their labels and undone as yes or no."""
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in labels.items() for x in p]), F.col(kind)), F.col(kind)) if labels else F.col(kind)
    newest = log.orderBy(F.col(order).desc()).limit(limit).orderBy(order)
    newest.withColumns({kind: named, "undone": F.when(F.col("undone").cast("boolean"), "yes").otherwise("no")}).select(*columns).write.csv(path, header=True)
