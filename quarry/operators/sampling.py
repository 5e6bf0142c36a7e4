"""Samples and augmentation. Randomness is a hash of ids and a seed, so a sample is the same in every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.relational import MODULUS, dense_number, pseudo_random


def unit(id_col: str, seed: int = 0) -> Column:
    """A number in [0, 1) for each id."""
    return pseudo_random(id_col, seed) / MODULUS


def fraction(df: DataFrame, id_col: str, share: float, seed: int = 0) -> DataFrame:
    """About `share` of the rows: those whose number falls below it. No shuffle, no count."""
    return df.where(unit(id_col, seed) < share)


def exactly(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement: each task sends its n least numbers at most."""
    return df.withColumn("__h", pseudo_random(id_col, seed)).orderBy("__h", id_col).limit(n).drop("__h")


def bootstrap(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement (draw, and the row): draws name places in the order of the ids, and are joined to them."""
    total = df.count()
    placed = dense_number(df, [id_col], "__place")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (pseudo_random("id", seed) % max(total, 1)).alias("__place"))
    return draws.join(placed, "__place").drop("__place")


def per_class(df: DataFrame, id_col: str, label: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each class at most."""
    w = W.partitionBy(label).orderBy(pseudo_random(id_col, seed), id_col)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def proportional(df: DataFrame, id_col: str, label: str, share: float, seed: int = 0) -> DataFrame:
    """The same share of each class, rounded up."""
    w = W.partitionBy(label)
    place = F.row_number().over(w.orderBy(pseudo_random(id_col, seed), id_col))
    return df.withColumn("__ok", place <= F.ceil(F.count("*").over(w) * share)).where("__ok").drop("__ok")


def weighted(df: DataFrame, id_col: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement with odds by weight: the largest u ** (1 / w)."""
    u = (pseudo_random(id_col, seed) + 1) / (MODULUS + 1)
    return df.where(F.col(weight) > 0).withColumn("__k", F.log(u) / F.col(weight)).orderBy(F.desc("__k"), id_col).limit(n).drop("__k")


def mini_batches(df: DataFrame, id_col: str, size: int, seed: int = 0) -> DataFrame:
    """A batch number for each row of a random order."""
    ordered = dense_number(df.withColumn("__h", pseudo_random(id_col, seed)), ["__h", id_col], "__n").drop("__h")
    return ordered.withColumn("batch", F.floor(F.col("__n") / size)).drop("__n")


def perturbed(df: DataFrame, id_col: str, columns: Sequence[str], eps: float, seed: int = 0) -> DataFrame:
    """Each column moved by up to eps either way."""
    return df.withColumns({c: F.col(c) + (unit(id_col, seed + i) * 2 - 1) * eps for i, c in enumerate(columns)})


def sign_perturbed(df: DataFrame, columns: Sequence[str], gradients: Sequence[Column], eps: float) -> DataFrame:
    """Each column moved by eps along its gradient's sign."""
    return df.withColumns({c: F.col(c) + eps * F.signum(g) for c, g in zip(columns, gradients, strict=True)})


def mixed(df: DataFrame, id_col: str, columns: Sequence[str], alpha: float) -> DataFrame:
    """Convex mixtures of each row with the next one in the order of the ids; the last row with the first."""
    numbered = dense_number(df.select(id_col, *columns), [id_col])
    n = df.count()
    other = numbered.select(F.pmod(F.col("row_no") - 1, F.lit(max(n, 1))).alias("row_no"), *(F.col(c).alias(f"__{c}") for c in columns))
    return numbered.join(other, "row_no").select(id_col, *((alpha * F.col(c) + (1 - alpha) * F.col(f"__{c}")).alias(c) for c in columns))
