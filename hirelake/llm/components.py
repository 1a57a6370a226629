"""Connected components by alternating stars (large-star, small-star) on DataFrames.

Each round is two aggregates and two joins over the links that are left; the rounds grow with the
logarithm of the longest chain. A group with very many members becomes a star whose centre is met
by map-side partial minima, and by a join that has one row per node on its other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    to_least = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.unionByName(least.withColumnRenamed("m", "v"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of bigint nodes -> (node, root): the least node reachable, for every node with a
    link. A link of a node with itself says nothing; nodes without any other link are not returned."""
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .where("u <> v").distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        edges = stored(_small_star(_large_star(edges).distinct()).distinct(), "stars")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    # at the end every link leads to the root
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
