"""Matrices as tables of (i, j, v), and vectors as array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_cells(df: DataFrame, row: str, columns: Sequence[str], keep_zeros: bool = False) -> DataFrame:
    """(i, j, v): the non-zero cells of a wide table."""
    cells = F.explode(F.array(*(F.struct(F.lit(j).cast("long").alias("j"), F.col(c).cast("double").alias("v")) for j, c in enumerate(columns))))
    out = df.select(F.col(row).cast("long").alias("i"), cells.alias("s")).select("i", "s.j", "s.v").where("v IS NOT NULL")
    return out if keep_zeros else out.where("v <> 0")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """One join on the inner index and one sum."""
    x, y = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def stack(a: DataFrame, b: DataFrame, axis: int, size: int) -> DataFrame:
    """b below a (axis 0) or beside it (axis 1); size: a's length along that axis."""
    return a.unionByName(b.withColumn("ij"[axis], F.col("ij"[axis]) + size))


def add(a: DataFrame, b: DataFrame, scale: float = 1.0) -> DataFrame:
    return a.unionByName(b.withColumn("v", F.col("v") * scale)).groupBy("i", "j").agg(F.sum("v").alias("v"))


def trace(m: DataFrame) -> DataFrame:
    return m.where("i = j").agg(F.sum("v").alias("trace"))


def frobenius(m: DataFrame) -> DataFrame:
    return m.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where either is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def top_eigen(m: DataFrame, k: int, rounds: int = 50, tolerance: float = 1e-9) -> list[tuple[float, DataFrame]]:
    """(value, vector (i, v)) of the k eigenvalues of largest size of a symmetric matrix of cells (i, j, v): power steps by joins, each vector kept apart from those before."""
    from quarry.operators._store import stored

    out: list[tuple[float, DataFrame]] = []
    nodes = stored(m.select("i").union(m.select("j")).distinct(), "nodes")

    def apart(x: DataFrame) -> DataFrame:
        for _, e in out:
            p = x.join(e.withColumnRenamed("v", "e"), "i").agg(F.coalesce(F.sum(F.col("v") * F.col("e")), F.lit(0.0)).alias("p"))
            x = x.join(e.withColumnRenamed("v", "e"), "i").crossJoin(F.broadcast(p)).select("i", (F.col("v") - F.col("p") * F.col("e")).alias("v"))
        return x

    for r in range(k):
        x = nodes.select("i", (F.lit(1.0) + F.pmod(F.xxhash64("i", F.lit(r)), F.lit(1000)) / 1000).alias("v"))
        value = 0.0
        for _ in range(rounds):
            x = apart(x)
            size = x.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 1.0
            unit = stored(x.select("i", (F.col("v") / size).alias("v")), "vector")
            x = stored(nodes.join(m.join(unit.select(F.col("i").alias("j"), F.col("v").alias("u")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("u")).alias("v")), "i", "left").na.fill(0.0), "vector")
            new = x.join(unit.withColumnRenamed("v", "u"), "i").agg(F.sum(F.col("v") * F.col("u"))).first()[0] or 0.0
            done, value = abs(new - value) <= tolerance * max(1.0, abs(new)), new
            if done:
                break
        out.append((float(value), unit))
    return out


def non_negative_factors(cells: DataFrame, rank: int, penalty: float = 0.01, rounds: int = 10):
    """(rows, columns) of non-negative factors of cells (i, j, v), by alternating least squares: tables (id, features)."""
    from pyspark.ml.recommendation import ALS

    t = cells.select(F.col("i").cast("int"), F.col("j").cast("int"), F.col("v").cast("float"))
    model = ALS(userCol="i", itemCol="j", ratingCol="v", rank=rank, regParam=penalty, maxIter=rounds, nonnegative=True, seed=1).fit(t)
    return model.userFactors, model.itemFactors
