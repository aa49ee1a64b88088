"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import spent, spill


def _stars(edges: DataFrame) -> bool:
    """Every u has one edge and no v is a u: nothing is left to do."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.filter("up > 1 OR (up > 0 AND down > 0)").agg(F.count(F.lit(1))).first()[0]


def _lowest(edges: DataFrame, tag: str) -> DataFrame:
    """Least neighbour of each u, written out so that the join with it has two plain exchanges."""
    return spill(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"), tag, narrow=True)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    Links may repeat and run either way; self-links are dropped; no links give no rows.
    Each round is written to the shared folder, so a lost executor costs one round.
    """
    with spent(links.sparkSession) as keep:
        edges = keep(_settled(links, a, b, rounds))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _settled(links: DataFrame, a: str, b: str, rounds: int) -> DataFrame:
    """Edges (u, v) from each node to the smallest of its component."""
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = spill(edges, "links", narrow=True)
    for _ in range(rounds):
        if _stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both, "large")
        large = both.join(low, F.col("u") == F.col("n")).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = spill(large.distinct(), "large-star", narrow=True)
        low = _lowest(large, "small")
        small = large.join(low, F.col("u") == F.col("n")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = spill(small.unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), "small-star", narrow=True)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges
