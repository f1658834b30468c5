"""Connected components of a link table, as DataFrame work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimweave.llm.common import saved

SALTS = 16


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the smallest of u and its neighbours; a node with very many edges is split by salts."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "salt"]).drop("salt")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    crossed = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count("*").alias("all")).where("out > 1 OR (out = 1 AND all > 1)")
    return crossed.isEmpty()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node in ``links`` (a, b); alternating large and small stars.

    Loops, repeated links and links in both directions are fine; NULL ends are left out; without links the
    result is empty. Every round writes its edges, so no lineage grows and a lost executor costs one round
    at most. The rounds needed grow with the logarithm of the nodes; edges that have not settled after
    ``rounds`` raise an error, so no link is ever lost silently.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = saved(edges, "edges")
    done = 0
    while not _settled(edges):
        if done == rounds:
            raise RuntimeError(f"the components have not settled after {rounds} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = _least(large)
        stars = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = saved(stars.distinct(), "edges")
        done += 1
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
