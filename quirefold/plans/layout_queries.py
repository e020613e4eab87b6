"""Queries that break texts and fill pages. `conversations` is a carrier: a turn is a heading and a paragraph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.operators import flow_layout
from quirefold.plans.registry import query
from quirefold.session import table


@query("total_fit_break")
def q_total_fit_break(spark, sf_dir):
    """Total-fit lines of every document; tested against all ways to break small paragraphs."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", flow_layout.total_fit_lines(F.col("text"), 40.0).alias("lines"))


def _placed(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    parts = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("role").alias("t")), F.struct(F.lit(1).alias("k"), F.col("text").alias("t"))))
    blocks = turns.select("conv_id", "turn", parts.alias("b")).select(
        "conv_id", (F.col("turn") * 2 + F.col("b.k")).alias("seq"), (F.col("b.k") == 0).alias("heading"), F.col("b.t").alias("text")
    )
    return flow_layout.layout(blocks, "conv_id", "seq", "heading", "text")


@query("page_layout")
def q_page_layout(spark, sf_dir):
    """Where the blocks of each conversation fall on its pages; tested for lost lines, lone lines and headings at the foot."""
    return _placed(spark, sf_dir)


@query("layout_round_trip", """
WITH b AS (SELECT conv_id, turn * 2 AS seq, role AS t FROM conversations UNION ALL SELECT conv_id, turn * 2 + 1, text FROM conversations),
n AS (SELECT conv_id, seq, trim(regexp_replace(t, '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM b)
SELECT conv_id, CAST(seq AS BIGINT) AS seq, text FROM n WHERE length(text) > 0""")
def q_layout_round_trip(spark, sf_dir):
    """The placed lines, put together again, are the blocks that went in."""
    placed = _placed(spark, sf_dir)
    parts = F.array_sort(F.collect_list(F.struct("first_line", F.array_join("lines", " ").alias("t"))))
    return placed.groupBy("conv_id", "seq").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


@query("reshape_span", """
WITH w AS (SELECT doc_id, text, CAST(length(text) // 2 AS BIGINT) AS e FROM documents)
SELECT doc_id, CAST(CASE WHEN position(' ' IN reverse(substr(text, 1, e))) = 0 THEN 0 ELSE e - position(' ' IN reverse(substr(text, 1, e))) + 1 END AS BIGINT) AS first,
 CAST(CASE WHEN position(' ' IN substr(text, e + 1)) = 0 THEN length(text) ELSE e + position(' ' IN substr(text, e + 1)) END AS BIGINT) AS past FROM w""")
def q_reshape_span(spark, sf_dir):
    """An edit in the middle of each document, widened to the words (behind their spaces) around it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.length("text") / 2).cast("int").alias("e"))
    head, tail = F.substring("text", F.lit(1), F.col("e")), F.substring("text", F.col("e") + 1, F.length("text"))
    back, ahead = F.instr(F.reverse(head), " "), F.instr(tail, " ")
    first = F.when(back == 0, 0).otherwise(F.col("e") - back + 1)
    past = F.when(ahead == 0, F.length("text")).otherwise(F.col("e") + ahead)
    return docs.select("doc_id", first.cast("long").alias("first"), past.cast("long").alias("past"))
