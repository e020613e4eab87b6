"""Tables in plain text: consecutive lines of cells between bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import stats

BAR = " | "


def rows_of(lines: DataFrame) -> DataFrame:
    """(doc_id, line, first, cells) of lines (doc_id, line, text) with a bar; `first` is the line that opens the table."""
    found = lines.where(F.instr("text", BAR) > 0)
    cells = F.transform(F.split("text", r"\|"), lambda c: F.trim(c))
    island = F.col("line") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    marked = found.select("doc_id", "line", cells.alias("cells"), island.alias("island"))
    return marked.withColumn("first", F.min("line").over(Window.partitionBy("doc_id", "island"))).drop("island")


def gfm(rows: Column, width: Column) -> Column:
    """GitHub-flavoured table of rows of cells without a declared header, whose header row is empty. Short rows are filled up."""
    bar = lambda cells: F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(" "), c, F.lit(" |"))), ""))
    filled = lambda cells: F.concat(cells, F.array_repeat(F.lit(""), (width - F.size(cells)).cast("int")))
    head = bar(F.array_repeat(F.lit(""), width.cast("int")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width.cast("int")))
    return F.concat_ws("\n", head, rule, F.array_join(F.transform(rows, lambda r: bar(filled(r))), "\n"))


def tables(lines: DataFrame) -> DataFrame:
    """(doc_id, first, n_rows, n_columns, fill, markdown) per table; `fill` is the share of its cells that aren't empty."""
    rows = rows_of(lines)
    gathered = rows.groupBy("doc_id", "first").agg(F.array_sort(F.collect_list(F.struct("line", "cells"))).alias("r"))
    shaped = gathered.withColumn("rows", F.col("r.cells")).withColumn("width", F.array_max(F.transform("rows", F.size)))
    cells = F.flatten("rows")
    fill = F.size(F.filter(cells, lambda c: c != "")) / F.size(cells)
    return shaped.select(
        "doc_id", "first", F.size("rows").cast("long").alias("n_rows"), F.col("width").cast("long").alias("n_columns"),
        stats.rounded(fill, 6).alias("fill"), gfm(F.col("rows"), F.col("width")).alias("markdown"),
    )


def cell(rows: Column, row: int, column: int) -> Column:
    """The cell at (row, column), counted from 0; null outside the table."""
    return F.get(F.get(rows, row), column)
