"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import staged


def components(edges: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node it can reach.

    Large-star and small-star steps alternate until the edges are stars around their roots. A
    node's smallest neighbour comes from an aggregate with partial sums before the shuffle, and is
    joined back, so that a hub with a third of all edges is a skewed join and no single group.
    Every round is a stage table in the shared folder.
    """
    u, v = F.col("u"), F.col("v")
    now = staged(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .filter("u IS NOT NULL AND v IS NOT NULL AND u > v").distinct()
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.first(u), F.min(v)).alias("m"))
        large = both.filter(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u")
        now = staged(
            small.filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
            .union(nearest.select("u", F.col("m").alias("v"))).distinct()
        )
        after = mark(now)
        if after == before:
            return now.select(u.alias("node"), v.alias("root")).union(
                now.select(v.alias("node"), v.alias("root")).distinct()
            )
        before = after
    raise RuntimeError(f"no stars after {rounds} rounds")
