"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations.

Logs often hold a conversation once per turn, each snapshot a prefix of the next. A rolling hash over a
conversation's turns, a running xor of the turns' hashes with their positions, gives a fingerprint of each of its
prefixes (128 bits and the length); a conversation whose whole fingerprint is that of a proper prefix
of another one goes, and of equal conversations the smallest id stays. What remains is maximal and is rendered.

Fingerprints come from one window over a conversation's turns, which spills and keeps no list; only a conversation that is
rendered is gathered, as its text is one value anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import checkpointed

# The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def fingerprints(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per turn: conv_id, lone, pos, turn, role, text, and the fingerprint (pos, one, two) of the prefix it ends.

    Null roles and texts count as empty; turns with one number are ordered by role and text, and equal turns stay
    apart. A turn without a conversation id is a conversation of its own (lone tells those apart, 0 for others).
    """
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.when(F.col(conv).cast("long").isNull(), F.monotonically_increasing_id() + 1).otherwise(0).alias("lone"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id", "lone").orderBy("turn", "role", "text")
    placed = rows.withColumn("pos", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rolling = lambda salt: F.bit_xor(F.xxhash64("pos", "role", "text", F.lit(salt))).over(so_far)
    return placed.withColumns({"one": rolling(1), "two": rolling(2)})


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, lone) of the conversations that are no proper prefix of another one, one of each group of equal ones.

    The fingerprints of short prefixes may be shared by very many conversations; aggregates combine them map-side.
    """
    last = prefixes.groupBy("conv_id", "lone").agg(F.max(F.struct("pos", "one", "two")).alias("whole"))
    kept = last.groupBy("whole").agg(F.min(F.struct(F.col("conv_id").isNull().alias("unnamed"), "conv_id", "lone")).alias("c"))
    ends = prefixes.join(last, (prefixes["conv_id"].eqNullSafe(last["conv_id"])) & (prefixes["lone"] == last["lone"]))
    proper = ends.where("pos < whole.pos").select(F.struct("pos", "one", "two").alias("whole")).distinct()
    return kept.join(proper, "whole", "left_anti").select("c.conv_id", "c.lone")


def render(role: str = "role", text: str = "text"):
    """A turn as a marked block."""
    return F.concat(F.lit(OPEN), F.col(role), F.lit("\n"), F.col(text), F.lit(CLOSE + "\n"))


def format_chats(turns: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, n_turns, rendered) per maximal conversation; an empty table gives none. Other columns are ignored."""
    prefixes = checkpointed(fingerprints(turns, **columns))
    ids = maximal(prefixes).select(F.col("conv_id").alias("own"), F.col("lone").alias("single"))
    stay = F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("lone") == F.col("single"))
    blocks = prefixes.join(ids, stay, "left_semi").select("conv_id", "lone", "pos", render().alias("block"))
    gathered = blocks.groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("b"))
    return gathered.select("conv_id", F.size("b").cast("long").alias("n_turns"), F.array_join("b.block", "").alias("rendered"))
