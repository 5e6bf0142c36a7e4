"""The data behind charts, as small DataFrames: counts, quantiles and grids, whatever the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.special import norm_ppf
from quarry.operators.binning import digitize, equal_width_edges


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n)."""
    edges = equal_width_edges(df, column, bins)
    t = df.where(F.col(column).isNotNull()).groupBy(digitize(F.col(column), edges).alias("bin")).agg(F.count("*").alias("n"))
    cells = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    return cells.join(t, "bin", "left").na.fill(0, ["n"])


def box_stats(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges (ends of the data within them) and the count beyond."""
    q = df.groupBy(*by).agg(*(F.percentile(column, F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(column).between(F.col("q1") - reach, F.col("q3") + reach)
    t = df.join(q, list(by))
    return t.groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(column))).alias("low"), F.max(F.when(inside, F.col(column))).alias("high"), F.count_if(~inside).alias("outliers"))


def grid_counts(df: DataFrame, x: str, y: str, nx: int, ny: int) -> DataFrame:
    """(bx, by, n): a two-way histogram."""
    ex, ey = equal_width_edges(df, x, nx), equal_width_edges(df, y, ny)
    return df.groupBy(digitize(F.col(x), ex).alias("bx"), digitize(F.col(y), ey).alias("by")).agg(F.count("*").alias("n"))


def normal_quantiles(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """(p, theoretical, sample): quantiles against those of a normal law."""
    at = [(i + 0.5) / points for i in range(points)]
    sample = df.agg(F.percentile(column, F.array(*map(F.lit, at)))).first()[0]
    return df.sparkSession.createDataFrame([(p, norm_ppf(p), float(s)) for p, s in zip(at, sample, strict=True)], "p double, theoretical double, sample double")


def cumulative_shares(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """(value, share): the distribution function at quantiles."""
    at = [(i + 1) / points for i in range(points)]
    values = df.agg(F.percentile(column, F.array(*map(F.lit, at)))).first()[0]
    return df.sparkSession.createDataFrame([(float(v), p) for v, p in zip(values, at, strict=True)], "value double, share double")


def density(df: DataFrame, column: str, points: int = 64, bins: int = 512) -> DataFrame:
    """(x, density): a Gaussian kernel over a fine histogram, of Silverman's width."""
    n, sd = df.agg(F.count(column), F.stddev_samp(column)).first()
    width = 1.06 * (sd or 1.0) * max(n, 1) ** -0.2
    fine = histogram(df, column, bins).select(((F.col("low") + F.col("high")) / 2).alias("c"), "n")
    lo, hi = fine.agg(F.min("c"), F.max("c")).first()
    xs = df.sparkSession.range(points).select((F.lit(lo) + F.col("id") * ((hi - lo) / (points - 1))).alias("x"))
    z = (F.col("x") - F.col("c")) / width
    return xs.crossJoin(F.broadcast(fine)).groupBy("x").agg((F.sum(F.col("n") * F.exp(-z * z / 2)) / (n * width * math.sqrt(2 * math.pi))).alias("density"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """(bin, n, predicted, observed)."""
    return df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"))


def pareto(df: DataFrame, category: str) -> DataFrame:
    """(category, n, cumulative share), commonest first."""
    t = df.groupBy(category).agg(F.count("*").alias("n"))
    w = W.orderBy(F.desc("n"), category)
    return t.withColumn("share", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(W.partitionBy()))


def bars(df: DataFrame, category: str, value: Column, by: str | None = None) -> DataFrame:
    """(category[, by], value): one aggregate for each bar, or for each bar of each group."""
    return df.groupBy(category, *([by] if by else [])).agg(value.alias("value"))


def line(df: DataFrame, ts: str, unit: str, value: Column) -> DataFrame:
    """(at, value): an aggregate for each stretch of time, in the order of time."""
    return df.groupBy(F.date_trunc(unit, ts).alias("at")).agg(value.alias("value")).orderBy("at")


def band(df: DataFrame, x: Column, column: str, z: float = 1.959963984540054) -> DataFrame:
    """(x, n, mean, low, high): the mean at each x and its normal interval; of one row there is none."""
    t = df.groupBy(x.alias("x")).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("s"))
    half = F.col("s") / F.sqrt("n") * z
    return t.select("x", "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def prediction_interval(df: DataFrame, y: str, predicted: str, z: float = 1.959963984540054) -> DataFrame:
    """df with low and high: the prediction and z deviations of the residuals about their mean."""
    e = F.col(y) - F.col(predicted)
    t = df.agg(F.avg(e).alias("__m"), F.stddev_samp(e).alias("__s"))
    mid = F.col(predicted) + F.col("__m")
    return df.crossJoin(F.broadcast(t)).withColumns({"low": mid - z * F.col("__s"), "high": mid + z * F.col("__s")}).drop("__m", "__s")


def members_interval(df: DataFrame, members: Sequence[str], z: float = 1.959963984540054) -> DataFrame:
    """df with mean, low and high over the predictions of an ensemble's members."""
    n = len(members)
    mean = sum((F.col(c) for c in members), F.lit(0.0)) / n
    spread = F.sqrt(sum(((F.col(c) - mean) * (F.col(c) - mean) for c in members), F.lit(0.0)) / max(1, n - 1))
    return df.withColumns({"mean": mean, "low": mean - z * spread, "high": mean + z * spread})


def probability_points(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """(p, normal): the share of rows up to each of the sample's quantiles, against what a normal law of its moments gives there."""
    from quarry.functions.special import norm_cdf

    at = [(i + 0.5) / points for i in range(points)]
    x = F.col(column).cast("double")
    t = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.percentile(x, F.array(*map(F.lit, at))).alias("q"))
    each = t.select("m", "s", F.explode(F.arrays_zip(F.array(*map(F.lit, at)).alias("p"), F.col("q").alias("v"))).alias("x"))
    return each.select(F.col("x.p").alias("p"), norm_cdf((F.col("x.v") - F.col("m")) / F.col("s")).alias("normal"))


def strips(df: DataFrame, category: str, column: str, bins: int = 40) -> DataFrame:
    """(category, bin, n, low, half_width): dots of a strip or swarm: how many of a category lie side by side in a bin, and how wide they are drawn."""
    edges = equal_width_edges(df, column, bins)
    t = df.where(F.col(column).isNotNull()).groupBy(category, digitize(F.col(column), edges).alias("bin")).agg(F.count("*").alias("n"))
    return t.withColumn("low", F.element_at(F.array(*map(F.lit, edges)), F.col("bin") + 1)).withColumn("half_width", F.sqrt(F.col("n")))


def raincloud(df: DataFrame, category: str, column: str, bins: int = 40) -> DataFrame:
    """(category, bin, share, q1, median, q3): each category's histogram as shares, with its quartiles."""
    edges = equal_width_edges(df, column, bins)
    rows = df.where(F.col(column).isNotNull())
    q = rows.groupBy(category).agg(F.count("*").alias("total"), *(F.percentile(column, F.lit(v)).alias(n) for v, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))
    t = rows.groupBy(category, digitize(F.col(column), edges).alias("bin")).agg(F.count("*").alias("n"))
    return t.join(q, category).select(category, "bin", (F.col("n") / F.col("total")).alias("share"), "q1", "median", "q3")


def cluster_summary(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """(cluster, n, and each column's mean and deviation): what a picture of clusters draws."""
    return df.groupBy(cluster).agg(F.count("*").alias("n"), *(e.alias(f"{k}_{c}") for c in columns for k, e in (("mean", F.avg(c)), ("std", F.stddev_pop(c)))))


def network(edges: DataFrame, most: int = 200) -> DataFrame:
    """(src, dst, w) of the edges between the `most` nodes of largest degree: what a picture of a graph draws. The limit is the picture's."""
    degree = edges.select(F.col("src").alias("node"), "w").unionByName(edges.select(F.col("dst").alias("node"), "w")).groupBy("node").agg(F.sum("w").alias("d"))
    top = degree.orderBy(F.desc("d"), "node").limit(most).select("node")
    return edges.join(F.broadcast(top.withColumnRenamed("node", "src")), "src").join(F.broadcast(top.withColumnRenamed("node", "dst")), "dst").select("src", "dst", "w")
