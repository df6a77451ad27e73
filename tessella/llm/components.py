"""Connected components of a distributed graph by alternating large-star and small-star rounds.

Edges stay a table throughout; each round is two partial minima and two joins, and is written to the shared folder, which cuts the
lineage. A round never makes more edges than it reads, so a hub costs its degree; the minimum of a hub's neighbours is found with
map-side aggregation, and its join can be split. Only the table's count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


def _star(edges: DataFrame) -> DataFrame:
    """edges a-b with both directions given as (u, v) -> (v, least neighbour of u)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, stored: Stored, most_rounds: int = 100) -> DataFrame:
    """edges: a, b (bigint) -> node, root (the least node reachable), for every node that has an edge to another."""
    now = stored.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        # Large star: every greater neighbour of u goes to the least of u and its neighbours.
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both).select("v", "u", F.least("m", "u").alias("m")).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # Small star: every lesser neighbour of u, and u itself, goes to the least of them.
        down = large.filter("a > b").distinct().select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _star(down).select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        then = stored.put(small.select("e.*").filter("a <> b").distinct())
        stored.drop(now)
        now = then
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
    raise RuntimeError("the components did not settle")
