"""Connected components of link tables that may be larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import checkpointed, hint_if_few, release


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of the links reaches, except for the roots themselves.

    Alternates large-star and small-star steps (each node's larger, then smaller, neighbours are hung
    on its smallest one) until nothing changes; every step is an aggregate and a join, with map-side
    combine for nodes with very many links, and its result is written to the shared folder.
    """
    links = checkpointed(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    before, hint = None, hint_if_few(2 * links.count())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(hint(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every link points from the larger node to a smaller one.
        small = large.join(hint(large.groupBy("u").agg(F.min("v").alias("m"))), "u")
        links = checkpointed(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        release(links.sparkSession)
