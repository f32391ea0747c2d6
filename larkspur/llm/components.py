"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins on vertex ids; its result is written to the
shared folder, so lineage stays short and nothing of the graph reaches the driver but a
count and a checksum. Components of a star-shaped input need two or three rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written first: a join of two scans lets the adaptive skew join split a hub's neighbours.
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) edges of integer ids, u <> v, to (u, v): each vertex but the roots, with the
    least id of its component. Vertices without an edge are not in the result."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state or not new[0]:
            return edges
        state = new
        edges = written(_small_star(_large_star(edges)), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
