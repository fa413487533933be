"""Connected components by alternating star steps, for links that no machine can hold.

Every round moves all neighbours of a node to its smallest one (large star), then those
below it (small star); the rounds end when only stars are left, each around the smallest
node of its component. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.store import written

MAX_ROUNDS = 100


def _only_stars(edges: DataFrame) -> bool:
    """Has no node two smaller neighbours, or a smaller and a larger one? Another round would change nothing then."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(
        edges.select("b", F.lit(0), F.lit(1))
    )
    ends = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.where("below > 1 or (below = 1 and above = 1)").isEmpty()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of the links ``a, b`` (bigint) that is not the smallest
    of its component. Links in either direction, repeated ones and loops are allowed, nulls are
    left out. A node with most of the links stays one row in each aggregate; the joins on it are
    split by adaptive execution.
    """
    kept = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kept = written(kept, "links")
    rounds = 0
    while not _only_stars(kept):
        if rounds == MAX_ROUNDS:
            raise RuntimeError("components: no end after the allowed rounds")
        kept = written(_small(_large(kept)), "stars")
        rounds += 1
    return kept.select(F.col("a").alias("node"), F.col("b").alias("component"))
