"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links (a, b) -> (node, component): every linked node with the smallest node it reaches.

    A node's smallest neighbour is found by a combining aggregate, and written before it is joined to the links: nothing but
    exchanges then stands before the join, so that the links of a node with very many are split between tasks.
    """
    edges = written(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct(), "links")
    last = None
    while True:
        # Large star: every larger neighbour of a node is linked with the smallest node of the neighbourhood.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "low")
        edges = written(both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct(), "star")
        # Small star: every smaller neighbour of a node, and the node, are linked with the smallest.
        low = written(edges.groupBy("v").agg(F.min("u").alias("m")), "low")
        joined = edges.join(low, "v").select(F.col("m").alias("u"), F.col("u").alias("v"))
        edges = written(joined.unionByName(low.select(F.col("m").alias("u"), "v")).where("u < v").distinct(), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
