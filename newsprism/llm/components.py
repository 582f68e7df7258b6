"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprism.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _least_neighbour(directed: DataFrame) -> DataFrame:
    """For each ``a`` the least of itself and its neighbours; one partially aggregated shuffle."""
    return directed.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of 64-bit ids to one star per component: (member, root), root the least id, member > root.

    Roots have no row of their own. Self loops and repeated edges are ignored; an
    empty edge table gives an empty result. Every round is written to the shared
    checkpoint folder, so a lost executor costs one round at most. Rounds grow
    with the logarithm of a component's diameter. Only counts reach the driver.
    """
    current = cut_lineage(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (both.join(_least_neighbour(both), "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
                 .where("a <> b").distinct())
        current = cut_lineage(small)
        after = _state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("member"), F.col("b").alias("root"))
