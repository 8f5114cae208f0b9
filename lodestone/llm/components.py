"""Connected components of an edge table by alternating large-star and small-star rounds; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest of u and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and every smaller neighbour of u are tied to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    others = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return others.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges (a < b) -> (id, component), one row for each id that is not itself the smallest of its component.

    The rounds end at stars around the smallest ids, after a number of rounds that grows with the logarithm of the
    longest chain; each round is written to the shared folder."""
    edges = materialize(spark, edges.select("a", "b").distinct(), "edges")
    while not edges.isEmpty():
        tangled = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if not tangled and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            break
        edges = materialize(spark, _small_star(_large_star(edges)), "edges")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
