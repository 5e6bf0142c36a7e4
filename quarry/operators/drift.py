"""Goodness of fit, drift between two samples, unit roots and causality."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions import special
from quarry.operators.relational import running_sums


def ks_normal(df: DataFrame, value: str) -> DataFrame:
    """(n, d): the largest gap between the sample's and its normal law's distribution functions."""
    x = F.col(value).cast("double")
    st = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    t = running_sums(df.where(x.isNotNull()).groupBy(x.alias("x")).agg(F.count("*").alias("c")), "x", {"lo": "c"}).withColumn("hi", F.col("lo") + F.col("c")).crossJoin(F.broadcast(st))
    p = special.norm_cdf((F.col("x") - F.col("m")) / F.col("s"))
    gap = F.greatest(F.col("hi") / F.col("n") - p, p - (F.col("hi") - F.col("c")) / F.col("n"))
    return t.groupBy("n").agg(F.max(gap).alias("d"))


def chi_square_fit(df: DataFrame, category: str) -> DataFrame:
    """(k, chi2) against equal shares."""
    t = df.groupBy(category).agg(F.count("*").alias("o")).withColumn("e", F.avg("o").over(W.partitionBy()))
    return t.agg(F.count("*").alias("k"), F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")).alias("chi2"))


def linear_mmd(df: DataFrame, columns: Sequence[str], is_reference: Column) -> DataFrame:
    """Unbiased squared discrepancy of means under a linear kernel; one pass of sums, no pairs."""
    parts = []
    for name, cond in (("r", is_reference), ("c", ~is_reference)):
        parts += [F.count_if(cond).alias(f"n{name}")]
        for i, c in enumerate(columns):
            v = F.when(cond, F.col(c).cast("double"))
            parts += [F.sum(v).alias(f"s{name}{i}"), F.sum(v * v).alias(f"q{name}{i}")]
    t = df.agg(*parts)
    total = F.lit(0.0)
    for i in range(len(columns)):
        for name in "rc":
            s, q, n = F.col(f"s{name}{i}"), F.col(f"q{name}{i}"), F.col(f"n{name}")
            total = total + (s * s - q) / (n * (n - 1))
        total = total - 2 * F.col(f"sr{i}") * F.col(f"sc{i}") / (F.col("nr") * F.col("nc"))
    return t.select(total.alias("mmd2"))


def partial_correlations(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, str, float]]:
    """-P_ij / sqrt(P_ii P_jj) of the inverse correlation matrix."""
    import numpy as np

    from quarry.operators.statistics import factor_covariance

    _, cov = factor_covariance(df, columns)
    d = np.sqrt(np.diag(cov))
    p = np.linalg.pinv(cov / np.outer(d, d) + 1e-8 * np.eye(len(columns)))
    return [(columns[i], columns[j], float(-p[i, j] / math.sqrt(p[i, i] * p[j, j]))) for i in range(len(columns)) for j in range(i + 1, len(columns))]


def phillips_perron(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(by, n, rho, t): the regression of a series on its own last value, by running sums."""
    w = W.partitionBy(*by).orderBy(*order)
    d = df.select(*by, F.col(column).cast("double").alias("y"), F.lag(F.col(column).cast("double")).over(w).alias("x")).where("x IS NOT NULL")
    t = d.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("rho"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    rss = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    return t.where("n > 2 AND sxx > 0").select(*by, "n", "rho", ((F.col("rho") - 1) / F.sqrt(rss / (F.col("n") - 2) / F.col("sxx"))).alias("t"))


def granger(df: DataFrame, target: str, cause: str, order: Sequence[str], by: Sequence[str], lag: int = 1) -> dict[str, float]:
    """F test of whether the cause's lags improve the target's own: two least-squares fits over the pooled series, each from one pass."""
    import numpy as np

    from quarry.operators.statistics import factor_covariance

    w = W.partitionBy(*by).orderBy(*order)
    own = [F.lag(target, i).over(w).alias(f"o{i}") for i in range(1, lag + 1)]
    other = [F.lag(cause, i).over(w).alias(f"c{i}") for i in range(1, lag + 1)]
    rows = df.select(F.col(target).alias("y"), *own, *other).dropna()
    names = ["y", *(f"o{i}" for i in range(1, lag + 1)), *(f"c{i}" for i in range(1, lag + 1))]
    n = rows.count()
    _, cov = factor_covariance(rows, names)

    def rss(k: int) -> float:
        a, b = cov[1 : k + 1, 1 : k + 1], cov[1 : k + 1, 0]
        return float((cov[0, 0] - b @ np.linalg.pinv(a) @ b) * (n - 1))

    small, large = rss(lag), rss(2 * lag)
    free = n - 2 * lag - 1
    f = (small - large) / lag / (large / free)
    return {"n": n, "f": f, "p": special.f_sf(f, lag, free)}


def ljung_box(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], lags: int) -> DataFrame:
    """(by, q): n (n + 2) times the sum of r_k squared over n - k."""
    from quarry.operators.timeseries import autocorrelation

    r = autocorrelation(df, column, by, order, range(1, lags + 1))
    n = df.groupBy(*by).agg(F.count(column).alias("n"))
    return r.join(n, list(by)).groupBy(*by, "n").agg((F.col("n") * (F.col("n") + 2) * F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("lag")))).alias("q"))


def gaussian_ranks(df: DataFrame, column: str, id_col: str, name: str = "z") -> DataFrame:
    """Normal scores of average ranks, (rank - 0.5) / n, by a rational approximation of the inverse distribution function."""
    from quarry.operators.statistics import average_ranks

    n = df.where(F.col(column).isNotNull()).count()
    p = (F.col("__r") - 0.5) / n
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(q))
    # Abramowitz and Stegun 26.2.23; absolute error below 4.5e-4.
    tail = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return average_ranks(df.select(id_col, column), column, name="__r").select(id_col, column, F.when(p < 0.5, -tail).otherwise(tail).alias(name))


def synthetic_quality(real: DataFrame, made: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, ks, mean_gap, correlation_gap) of made rows against real ones: the largest gap of distribution functions, that of means in deviations, and the
    largest gap of the column's correlations with the others."""
    from quarry.operators.statistics import factor_covariance, ks_two_sample

    both = real.select(*columns, F.lit(True).alias("__r")).unionByName(made.select(*columns, F.lit(False).alias("__r")))
    import numpy as np

    (m1, c1), (m2, c2) = factor_covariance(real, columns), factor_covariance(made, columns)
    cor = [c / np.outer(np.sqrt(np.diag(c)), np.sqrt(np.diag(c))) for c in (c1, c2)]
    gap = np.abs(cor[0] - cor[1])
    np.fill_diagonal(gap, 0)
    rows = [(c, float(ks_two_sample(both, c, F.col("__r")).first()["d"]), float(abs(m1[i] - m2[i]) / math.sqrt(c1[i, i])), float(gap[i].max()) if len(columns) > 1 else 0.0) for i, c in enumerate(columns)]
    return real.sparkSession.createDataFrame(rows, "name string, ks double, mean_gap double, correlation_gap double")


def stationarity(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], lag: int = 2) -> DataFrame:
    """(by, kpss, t): the statistic against a level (large: not stationary) beside that against a unit root (far below zero: stationary)."""
    from quarry.operators.timeseries import kpss

    level = kpss(df, column, by, order, lag)
    name = next(c for c in level.columns if c not in by and c != "n")
    return level.select(*by, F.col(name).alias("kpss")).join(phillips_perron(df, column, by, order).select(*by, "t"), list(by), "full")
