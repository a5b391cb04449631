"""Connected components of a graph that is held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm._common import discard, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected graph; component is the smallest node reachable.

    Alternating large-star and small-star rounds: each edge is kept as (larger, smaller) and is first moved to the
    smallest neighbour of its smaller end, then all ends below a node are tied to the smallest of them. The number of
    rounds grows with the logarithm of the graph's size. Minima are aggregated map-side; they are written before they
    are joined back, so that both sides of the join have exchanges of their own and AQE splits the rows of a hub.
    Nulls and loops are left out. An empty graph has no rows.
    """
    flat = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null and v <> u")
    now = stored(flat.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct(), "edges")
    while True:
        below = now.groupBy("v").agg(F.min("u").alias("low"), F.count("*").alias("n"))
        low = stored(below, "low")  # of each larger end: its smallest neighbour below
        forest = now.join(low.select(F.col("v").alias("w"), "low"), F.col("u") == F.col("w"), "left")
        # an end u that has neighbours below hands them on: the smallest neighbour of u, or u itself
        moved = stored(forest.select("v", F.coalesce("low", "u").alias("u")).distinct(), "moved")
        least = stored(moved.groupBy("v").agg(F.min("u").alias("low"), F.count("*").alias("n")), "least")
        tied = moved.join(least.where("n > 1").select("v", "low"), "v").select(F.col("u").alias("v"), F.col("low").alias("u")).where("u <> v")
        after = stored(tied.union(least.select("v", F.col("low").alias("u"))).distinct(), "edges")
        discard(now, low, moved, least)
        now = after
        heads = now.select(F.col("u").alias("v")).distinct()
        many = now.groupBy("v").count().where("count > 1").limit(1)
        if not now.join(heads, "v", "left_semi").select("v").limit(1).union(many.select("v")).take(1):
            break
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
