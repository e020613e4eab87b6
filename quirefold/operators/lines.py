"""Text lines and the lines that repeat across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per non-empty line: (id, line_no from 0, line). A null text has no lines."""
    parts = F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line")
    return (
        docs.select(F.col(id_col).alias("doc_id"), parts)
        .where(F.length("line") > 0)
        .select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")
    )


def template(line: Column) -> Column:
    """Digit runs become the placeholder {}."""
    return F.regexp_replace(line, "[0-9]+", "{}")


def running_lines(lines: DataFrame, id_col: Column, least: int = 3) -> DataFrame:
    """Templates seen in at least `least` documents.

    Pre-aggregated to one row per (template, document), so a template on a third of all lines
    shuffles partial counts and no single task receives its lines.
    """
    per_doc = lines.groupBy(template(F.col("line")).alias("template"), id_col.alias("doc_id")).agg(F.count("*").alias("n"))
    return (
        per_doc.groupBy("template")
        .agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"))
        .where(F.col("n_docs") >= least)
    )
