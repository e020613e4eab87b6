"""Intervals, frames, splices and scores as window and aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def widest_gap(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, gap, middle) of the widest empty band between the intervals (begin, end) of each key."""
    order = Window.partitionBy(key).orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = spans.withColumn("reach", reach).where(F.col("begin") > F.col("reach"))
    sized = gaps.select(key, F.struct((F.col("begin") - F.col("reach")).alias("gap"), (-F.col("reach")).alias("low")).alias("g"))
    top = sized.groupBy(key).agg(F.max("g").alias("g"))
    return top.select(key, F.col("g.gap").alias("gap"), (-F.col("g.low") + F.col("g.gap") / 2).alias("middle"))


def splice(text: Column, start: Column, end: Column, insert: Column) -> Column:
    """The text with characters start..end (from 0, end excluded) replaced."""
    return F.concat(F.substring(text, F.lit(1), start), insert, F.substring(text, end + 1, F.length(text)))


def remap(offset: Column, start: Column, end: Column, inserted: Column) -> Column:
    """Where an old offset lies after a splice; null strictly inside the replaced span."""
    return F.when(offset <= start, offset).when(offset >= end, offset + inserted - (end - start))


def order_moved(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, same_lines, moved): whether both have the same multiset of lines, and at how many positions they differ."""
    sides = [
        pairs.join(lines, pairs[c] == lines["doc_id"]).select("a", "b", F.struct("line_no", "line").alias("l")).groupBy("a", "b")
        .agg(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]).alias(c * 2))
        for c in "ab"
    ]
    both = sides[0].join(sides[1], ["a", "b"])
    same = F.array_sort("aa") == F.array_sort("bb")
    moved = F.size(F.filter(F.zip_with("aa", "bb", lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    return both.select("a", "b", same.alias("same_lines"), F.when(same, moved).otherwise(0).cast("long").alias("moved"))


def best_match(scored: DataFrame, key: str = "key") -> DataFrame:
    """(key, best, score, runner_up) of (key, candidate, score): the lowest score, ties to the smaller candidate."""
    w = Window.partitionBy(key).orderBy("score", "candidate")
    ranked = scored.withColumn("rank", F.row_number().over(w)).withColumn("runner_up", F.lead("candidate").over(w))
    return ranked.where("rank = 1").select(key, F.col("candidate").alias("best"), "score", "runner_up")
