"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.session import materialise


def _pulled(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(v, m) for each edge (u, v), m being u's least neighbour; no loops, no repeats."""
    return (
        edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _pulled(both.where("v > u"), least)


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _pulled(down, least)
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of an edge: the smallest node of its component; roots are left out.

    `edges` has two columns u, v of one orderable type.  No node's neighbours
    are gathered: minima are aggregated and joined back.  Only two numbers per
    round come to the driver.
    """
    now = materialise(edges.select("u", "v").where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        now = materialise(_small_star(_large_star(now)))
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
