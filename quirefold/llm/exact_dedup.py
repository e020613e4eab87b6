"""Exact deduplication by heavy-hitter split, in DataFrame operations only.

1. Every text is reduced to its SHA-256 once; the digests go to the shared folder, so the texts
   are read a single time.
2. A Misra-Gries-type frequent-items summary (`approx_top_k`, built per task and merged) proposes at
   most `k` digests. A digest on more than about 1/(0.75 * tracked) of the rows can't be missed.
3. The proposals are counted exactly, with map-side combine. What this verifies (`k` rows of some
   100 bytes at most, whatever the input size) is broadcast and resolves its rows map-side: these rows
   never shuffle, whether a digest holds ten rows or a third of all.
4. The remaining digests, each a small share by construction, take an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import checkpointed, small_or_not

#: Most digests broadcast, and digests that the summary tracks.
HEAVY_K = 1000
TRACKED = 10_000


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text in UTF-8; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def heavy_digests(keyed: DataFrame, k: int = HEAVY_K, tracked: int = TRACKED) -> DataFrame:
    """Exact (digest, best, group_size) of at most `k` frequent digests that occur twice or more."""
    proposed = keyed.agg(F.expr(f"approx_top_k(digest, {k}, {tracked})").alias("top")).select(
        F.explode("top").alias("t")
    ).select(F.col("t.item").alias("digest"))
    return (
        keyed.join(F.broadcast(proposed), "digest")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = HEAVY_K, tracked: int = TRACKED
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Null counts as empty, so null and empty
    texts form one group. A row without an id never beats one that has an id. Rows that repeat both id
    and text are told apart by their position, so exactly one row of a group is kept. An empty
    table gives an empty result; other columns are ignored.
    """
    keyed = checkpointed(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            digest(F.col(text_col)).alias("digest"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    heavy = F.broadcast(checkpointed(heavy_digests(keyed, k, tracked)))
    same = Window.partitionBy("digest")
    parts = [
        keyed.join(heavy, "digest"),
        keyed.join(heavy, "digest", "left_anti").select(
            "*",
            F.max(F.struct("doc_id", "rid")).over(same).alias("best"),
            F.count("*").over(same).alias("group_size"),
        ),
    ]
    return parts[0].unionByName(parts[1]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        F.expr("rid = best.rid").alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    The ids of rows that go are broadcast if they are few, else joined, so that few copies cost no shuffle of the
    texts. Rows that repeat a kept (id, text) are reduced to one in a branch that is empty unless such rows exist.
    """
    groups = checkpointed(exact_groups(docs, id_col, text_col))
    named = [F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")]
    losers = small_or_not(groups.where("NOT (doc_id <=> keep_id)").select(*named).distinct())
    repeated = small_or_not(
        groups.where("doc_id <=> keep_id").groupBy("doc_id", "text_sha256").count().where("count > 1").select(*named)
    )
    # Rows travel as one column, so that no column of theirs can clash.
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own"), digest(F.col(text_col)).alias("text"))
    same = lambda side: (F.col("own").eqNullSafe(side["id"])) & (F.col("text") == side["digest"])
    kept = marked.join(losers, same(losers), "left_anti")
    if not repeated.head(1):
        return kept.select("row.*")
    once = kept.join(repeated, same(repeated), "left_anti")
    many = kept.join(repeated, same(repeated), "left_semi").dropDuplicates(["own", "text"])
    return once.unionByName(many).select("row.*")
