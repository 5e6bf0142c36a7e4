"""Categorical encoders. A fitted encoder is a small DataFrame of categories (one aggregate pass), joined at transform.

Categories are ordered by their text. Unknown and null categories get the encoder's documented default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.relational import pseudo_random


def categories(df: DataFrame, column: str, most: int = 10_000) -> list[str]:
    """Distinct values as sorted text, for encoders that make a column for each; more than `most` are an error."""
    found = [r[0] for r in df.select(F.col(column).cast("string").alias("v")).where("v IS NOT NULL").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} categories")
    return sorted(found)


def label_table(df: DataFrame, column: str) -> DataFrame:
    """(category, index): numbered by text. The distinct values alone are ordered, never the rows."""
    values = df.select(F.col(column).cast("string").alias("category")).where("category IS NOT NULL").distinct()
    return values.withColumn("index", F.row_number().over(W.orderBy("category")) - 1)


def encode_labels(df: DataFrame, column: str, table: DataFrame, name: str = "label") -> DataFrame:
    """Unknown and null: -1."""
    t = table.withColumnRenamed("index", name)
    return df.join(t, F.col(column).cast("string") == F.col("category"), "left").drop("category").withColumn(name, F.coalesce(name, F.lit(-1)))


def one_hot(df: DataFrame, column: str, values: Sequence[str], drop_first: bool = False) -> DataFrame:
    """A 0/1 column for each category; unknown: all zero."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column).cast("string") == v).cast("int"), F.lit(0)) for v in list(values)[int(drop_first) :]})


def effect_coded(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """k - 1 columns of 1/0; the last category is -1 in all of them, unknown 0."""
    x = F.col(column).cast("string")
    return df.withColumns({f"{column}_{v}": F.when(x == values[-1], -1).when(x == v, 1).otherwise(0) for v in values[:-1]})


def helmert_matrix(k: int) -> list[list[float]]:
    """Column 0 sets the first category against the mean of the others; column j the j-th against those before it."""
    rows = [[0.0] * (k - 1) for _ in range(k)]
    if k > 1:
        rows[0][0] = -1.0
        for i in range(1, k):
            rows[i][0] = 1 / (k - 1)
    for j in range(1, k - 1):
        for i in range(j + 1):
            rows[i][j] = -1 / (j + 1)
        rows[j + 1][j] = 1.0
    return rows


def helmert_coded(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    m = helmert_matrix(len(values))
    x = F.col(column).cast("string")

    def cell(j: int) -> Column:
        out = F.lit(0.0)
        for v, row in zip(values, m, strict=True):
            out = F.when(x == v, F.lit(row[j])).otherwise(out)
        return out

    return df.withColumns({f"{column}_h{j}": cell(j) for j in range(len(values) - 1)})


def thermometer(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """k - 1 bits; the first `position` are set."""
    place = F.array_position(F.array(*map(F.lit, values)), F.col(column)) - 1
    return df.withColumns({f"{column}_t{j}": F.coalesce((place > j).cast("int"), F.lit(0)) for j in range(len(values) - 1)})


def binary_coded(df: DataFrame, column: str, table: DataFrame, bits: int) -> DataFrame:
    """The label's bits, highest first; unknown: -1 in each."""
    labelled = encode_labels(df, column, table, "__i")
    return labelled.withColumns({f"{column}_b{b}": F.when(F.col("__i") < 0, -1).otherwise(F.shiftright("__i", bits - 1 - b).bitwiseAND(F.lit(1))) for b in range(bits)}).drop("__i")


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """(category, n, share)."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("category")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def joined_value(df: DataFrame, column: str, table: DataFrame, value: str, default: float | Column, name: str) -> DataFrame:
    t = table.select("category", F.col(value).alias(name))
    return df.join(t, F.col(column).cast("string") == F.col("category"), "left").drop("category").withColumn(name, F.coalesce(F.col(name), default if isinstance(default, Column) else F.lit(default)))


def rare_merged(df: DataFrame, column: str, threshold: float, label: str = "Other") -> DataFrame:
    """Categories whose share is below the threshold become one."""
    t = frequency_table(df, column).where(F.col("share") >= threshold).select("category", F.lit(True).alias("__kept"))
    return df.join(t, F.col(column).cast("string") == F.col("category"), "left").withColumn(column, F.when(F.col("__kept"), F.col(column).cast("string")).otherwise(label)).drop("category", "__kept")


def target_table(df: DataFrame, column: str, target: str) -> DataFrame:
    """(category, n, mean, median, ones) of a numeric target."""
    y = F.col(target).cast("double")
    return df.groupBy(F.col(column).cast("string").alias("category")).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.percentile(y, F.lit(0.5)).alias("median"), F.sum(y).alias("ones"))


def overall(df: DataFrame, target: str) -> tuple[int, float, float]:
    """Count, mean and median of the target."""
    y = F.col(target).cast("double")
    n, mean, median = df.agg(F.count(y), F.avg(y), F.percentile(y, F.lit(0.5))).first()
    return n, mean or 0.0, median or 0.0


def smoothed_means(table: DataFrame, mean: float, smoothing: float) -> DataFrame:
    """(n * category mean + smoothing * mean) / (n + smoothing)."""
    return table.withColumn("value", (F.col("n") * F.col("mean") + smoothing * mean) / (F.col("n") + smoothing))


def ordered_prior_means(table: DataFrame, mean: float) -> DataFrame:
    """(n * category mean + prior) / (n + 1)."""
    return table.withColumn("value", (F.col("n") * F.col("mean") + mean) / (F.col("n") + 1))


def shrunken_effects(table: DataFrame, mean: float, smoothing: float) -> DataFrame:
    """n / (n + s) * (category mean - mean); categories of fewer than two rows have none."""
    return table.withColumn("value", F.when(F.col("n") < 2, 0.0).otherwise(F.col("n") / (F.col("n") + smoothing) * (F.col("mean") - mean)))


def median_values(table: DataFrame, median: float, least: int) -> DataFrame:
    return table.withColumn("value", F.when(F.col("n") < least, median).otherwise(F.col("median")))


def evidence_weights(table: DataFrame, regularization: float = 0.5) -> DataFrame:
    """ln of the share of non-events over the share of events, each count raised by `regularization`; target 0/1."""
    zeros = F.col("n") - F.col("ones")
    all_ones, all_zeros = F.sum("ones").over(W.partitionBy()), F.sum(zeros).over(W.partitionBy())
    return table.withColumn("value", F.log((zeros + regularization) / (all_zeros + regularization)) - F.log((F.col("ones") + regularization) / (all_ones + regularization)))


def out_of_fold_means(df: DataFrame, id_col: str, column: str, target: str, k: int, smoothing: float) -> DataFrame:
    """Each row gets its category's smoothed mean over the other folds: whole sums less the fold's own."""
    rows = df.withColumn("__f", pseudo_random(id_col) % k)
    y = F.col(target).cast("double")
    cell = rows.groupBy(column, "__f").agg(F.count(y).alias("__n"), F.sum(y).alias("__s"))
    by_cat = cell.groupBy(column).agg(F.sum("__n").alias("__cn"), F.sum("__s").alias("__cs"))
    by_fold = cell.groupBy("__f").agg(F.sum("__n").alias("__fn"), F.sum("__s").alias("__fs"))
    whole = by_fold.select(F.sum("__fn").alias("__an"), F.sum("__fs").alias("__as"))
    prior = by_fold.crossJoin(F.broadcast(whole)).select("__f", ((F.col("__as") - F.col("__fs")) / (F.col("__an") - F.col("__fn"))).alias("__prior"))
    table = cell.join(by_cat, column).join(F.broadcast(prior), "__f")
    n, s = F.col("__cn") - F.col("__n"), F.col("__cs") - F.col("__s")
    table = table.select(column, "__f", ((s + smoothing * F.col("__prior")) / (n + smoothing)).alias("encoded"))
    return rows.join(table, [column, "__f"], "left").drop("__f")


def hashed(x: Column, n: int) -> Column:
    """md5 of the text, its first 15 hexadecimal digits, modulo n."""
    return F.pmod(F.conv(F.substring(F.md5(x.cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(n)).cast("int")


def cyclic(df: DataFrame, column: str, period: float, harmonics: int = 1) -> DataFrame:
    """sin and cos of 2 pi h x / period."""
    turn = F.lit(2 * 3.141592653589793) * F.col(column) / period
    return df.withColumns({f"{column}_{name}{h}": f(turn * h) for h in range(1, harmonics + 1) for name, f in (("sin", F.sin), ("cos", F.cos))})
