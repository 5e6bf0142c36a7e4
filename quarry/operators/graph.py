"""Graph algorithms on edge tables (src, dst, w), as loops of joins whose state is cut by checkpoints."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed and kept in the folder of spark.checkpoint.dir, which all executors share."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quarry-"))
    return df.checkpoint()


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(node, rank) after `rounds` steps; the rank of nodes without outgoing edges is dealt to all."""
    nodes = checkpointed(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    n = nodes.count()
    total = edges.groupBy("src").agg(F.sum("w").alias("total"))
    share = checkpointed(edges.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    dangling = checkpointed(nodes.join(total.select(F.col("src").alias("node")), "node", "left_anti"))
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(rounds):
        lost = rank.join(dangling, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = share.join(rank, share["src"] == rank["node"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("given"))
        rank = nodes.join(given, nodes["node"] == given["dst"], "left").crossJoin(F.broadcast(lost)).select("node", ((1 - damping) / n + damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if i % 3 == 2:
            rank = checkpointed(rank)
    return rank


def shortest_paths(edges: DataFrame, source: object, limit: int | None = None) -> DataFrame:
    """(node, distance) from a source along positive weights: nodes whose distance fell relax their edges until none falls, or for `limit` steps."""
    best = checkpointed(edges.limit(1).select(F.lit(source).cast(edges.schema["src"].dataType).alias("node"), F.lit(0.0).alias("distance")))
    front = best
    for _ in itertools.count() if limit is None else range(limit):
        reached = edges.join(front, edges["src"] == front["node"]).groupBy("dst").agg(F.min(F.col("distance") + F.col("w")).alias("new"))
        front = checkpointed(reached.join(best, reached["dst"] == best["node"], "left").where("distance IS NULL OR new < distance").select(F.col("dst").alias("node"), F.col("new").alias("distance")))
        if front.isEmpty():
            break
        best = checkpointed(best.join(front.select("node"), "node", "left_anti").unionByName(front))
    return best


def bfs(edges: DataFrame, source: object, limit: int | None = None) -> DataFrame:
    """(node, distance) in steps, `limit` at most."""
    return shortest_paths(edges.select("src", "dst", F.lit(1.0).alias("w")), source, limit)


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"), F.sum("w").alias("out_weight"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"), F.sum("w").alias("in_weight"))
    return out.join(into, "node", "full").na.fill(0)


def morans_i(values: DataFrame, weights: DataFrame) -> DataFrame:
    """(n, i): values (node, x), weights (src, dst, w)."""
    stats = values.agg(F.count("*").alias("n"), F.avg("x").alias("m"))
    z = values.crossJoin(F.broadcast(stats)).select("node", "n", (F.col("x") - F.col("m")).alias("z"))
    a, b = z.select(F.col("node").alias("src"), F.col("z").alias("za"), "n"), z.select(F.col("node").alias("dst"), F.col("z").alias("zb"))
    top = weights.join(a, "src").join(b, "dst").agg(F.first("n").alias("n"), F.sum("w").alias("ws"), F.sum(F.col("w") * F.col("za") * F.col("zb")).alias("c"))
    low = z.agg(F.sum(F.col("z") * F.col("z")).alias("v"))
    return top.crossJoin(low).select("n", (F.col("n") / F.col("ws") * F.col("c") / F.col("v")).alias("i"))


def gearys_c(values: DataFrame, weights: DataFrame) -> DataFrame:
    """(n, c)."""
    stats = values.agg(F.count("*").alias("n"), F.var_samp("x").alias("v"))
    a, b = values.select(F.col("node").alias("src"), F.col("x").alias("xa")), values.select(F.col("node").alias("dst"), F.col("x").alias("xb"))
    gap = F.col("xa") - F.col("xb")
    top = weights.join(a, "src").join(b, "dst").agg(F.sum("w").alias("ws"), F.sum(F.col("w") * gap * gap).alias("s"))
    return top.crossJoin(stats).select("n", (F.col("s") / (2 * F.col("ws") * F.col("v"))).alias("c"))
