"""Windows over ordered series. Every operator takes keys and an order; a series is one key's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "median": lambda c: F.percentile(c, F.lit(0.5)), "count": F.count}


def lags(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], periods: Sequence[int], drop_incomplete: bool = False) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    out = df.withColumns({f"{column}_lag_{k}": F.lag(column, k).over(w) for k in periods})
    if drop_incomplete:
        out = out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") > max(periods)).drop("__n")
    return out


def rolling(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], size: int, how: str = "mean", least: int | None = None, center: bool = False, name: str | None = None) -> DataFrame:
    """Aggregate of the last `size` rows (or of those around); null while fewer than `least` values are there."""
    before = size // 2 if center else size - 1
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-before, size - 1 - before)
    value = AGGREGATES[how](F.col(column)).over(w)
    return df.withColumn(name or f"{column}_{how}_{size}", F.when(F.count(column).over(w) >= (least or size), value))


def windows(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], size: int, step: int = 1) -> DataFrame:
    """(by, start, values): overlapping windows of `size` rows, every `step` rows."""
    w = W.partitionBy(*by).orderBy(*order)
    out = df.withColumn("start", F.row_number().over(w) - 1).withColumn("values", F.collect_list(column).over(w.rowsBetween(0, size - 1)))
    return out.where((F.size("values") == size) & (F.col("start") % step == 0)).select(*by, "start", "values")


def ewma(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], alpha: float) -> DataFrame:
    """(by, order, value, ewma): m = alpha x + (1 - alpha) m. Each series passes one task once, in order; a null value leaves m as it is."""
    import pandas as pd

    keep = [*by, *order, column]
    rows = df.select(*by, *order, F.col(column).cast("double").alias(column))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", ewma double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(order), kind="stable")
        out, m = [], None
        for x in part[column].tolist():
            if x == x:
                m = x if m is None else alpha * x + (1 - alpha) * m
            out.append(m)
        return part.assign(ewma=out)[[*keep, "ewma"]]

    return rows.groupBy(*by).applyInPandas(run, schema)


def autocorrelation(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], lags_: Sequence[int]) -> DataFrame:
    """(by, lag, r): sum of products of deviations k apart over the sum of squares."""
    x = F.col(column).cast("double")
    key = W.partitionBy(*by)
    d = df.withColumn("__d", x - F.avg(x).over(key))
    w = key.orderBy(*order)
    t = d.withColumns({f"__l{k}": F.lag("__d", k).over(w) for k in lags_})
    sums = t.groupBy(*by).agg(F.sum(F.col("__d") * F.col("__d")).alias("__v"), *(F.sum(F.col("__d") * F.col(f"__l{k}")).alias(f"__s{k}") for k in lags_))
    cells = F.array(*(F.struct(F.lit(k).alias("lag"), F.when(F.col("__v") > 0, F.col(f"__s{k}") / F.col("__v")).alias("r")) for k in lags_))
    return sums.select(*by, F.explode(cells).alias("s")).select(*by, "s.lag", "s.r")


def seasonal_residuals(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], period: int) -> DataFrame:
    """Adds trend (centred mean), season (mean of the detrended values at a phase) and residual."""
    key = W.partitionBy(*by)
    n = F.row_number().over(key.orderBy(*order)) - 1
    half = period // 2
    out = df.withColumn("phase", n % period).withColumn("trend", F.avg(column).over(key.orderBy(*order).rowsBetween(-half, period - 1 - half)))
    out = out.withColumn("season", F.avg(F.col(column) - F.col("trend")).over(W.partitionBy(*by, "phase")))
    return out.withColumn("residual", F.col(column) - F.col("trend") - F.col("season"))


def seasonal_anomalies(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], period: int, threshold: float = 3.0) -> DataFrame:
    r = seasonal_residuals(df, column, by, order, period)
    key = W.partitionBy(*by)
    z = (F.col("residual") - F.avg("residual").over(key)) / F.when(F.stddev_pop("residual").over(key) > 0, F.stddev_pop("residual").over(key))
    return r.withColumn("is_anomaly", F.coalesce(F.abs(z) > threshold, F.lit(False)))


def kpss(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], lag: int) -> DataFrame:
    """(by, n, kpss): squared partial sums over Bartlett's long-run variance, about a level."""
    key = W.partitionBy(*by)
    w = key.orderBy(*order)
    t = df.withColumn("__e", F.col(column) - F.avg(column).over(key))
    t = t.withColumn("__s", F.sum("__e").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumns({f"__l{k}": F.lag("__e", k).over(w) for k in range(1, lag + 1)})
    sums = t.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("__s") * F.col("__s")).alias("ss"), F.sum(F.col("__e") * F.col("__e")).alias("g0"), *(F.sum(F.col("__e") * F.col(f"__l{k}")).alias(f"g{k}") for k in range(1, lag + 1)))
    var = F.col("g0") + sum((2 * (1 - k / (lag + 1)) * F.col(f"g{k}") for k in range(1, lag + 1)), F.lit(0.0))
    return sums.select(*by, "n", (F.col("ss") / F.col("n") / F.when(var > 0, var)).alias("kpss"))


def control_limits(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Individuals chart: centre and mean moving range * 2.66, and points beyond."""
    key = W.partitionBy(*by)
    t = df.withColumn("__mr", F.abs(F.col(column) - F.lag(column).over(key.orderBy(*order))))
    center, reach = F.avg(column).over(key), 2.66 * F.avg("__mr").over(key)
    return t.withColumn("center", center).withColumn("low", center - reach).withColumn("high", center + reach).withColumn("out_of_control", F.coalesce((F.col(column) < F.col("low")) | (F.col(column) > F.col("high")), F.lit(False))).drop("__mr")


def capability(df: DataFrame, column: str, low: float, high: float, by: Sequence[str] = ()) -> DataFrame:
    """Cp and Cpk with the sample deviation."""
    m, s = F.avg(column), F.stddev_samp(column)
    return df.groupBy(*by).agg(((high - low) / (6 * s)).alias("cp"), (F.least(high - m, m - low) / (3 * s)).alias("cpk"))


def shifts(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], size: int, threshold: float) -> DataFrame:
    """Points where the means of the `size` rows before and of those from here differ by more than `threshold` pooled deviations."""
    w = W.partitionBy(*by).orderBy(*order)
    a, b = w.rowsBetween(-size, -1), w.rowsBetween(0, size - 1)
    full = (F.count(column).over(a) == size) & (F.count(column).over(b) == size)
    pooled = F.sqrt((F.var_pop(column).over(a) + F.var_pop(column).over(b)) / 2)
    gap = F.abs(F.avg(column).over(b) - F.avg(column).over(a))
    return df.withColumn("is_shift", F.coalesce(full & (gap > threshold * pooled), F.lit(False)))


def chow_scan(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], least: int = 10) -> DataFrame:
    """(by, at, f): of the split of each series into two means, the largest F statistic; running sums serve every split."""
    key = W.partitionBy(*by)
    w = key.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    x = F.col(column).cast("double")
    t = df.select(*by, F.row_number().over(key.orderBy(*order)).alias("k"), F.sum(x).over(w).alias("s"), F.sum(x * x).over(w).alias("q"), F.count("*").over(key).alias("n"), F.sum(x).over(key).alias("all_s"), F.sum(x * x).over(key).alias("all_q"))
    k, n, rest = F.col("k"), F.col("n"), F.col("all_s") - F.col("s")
    whole = F.col("all_q") - F.col("all_s") * F.col("all_s") / n
    parts = F.col("all_q") - F.col("s") * F.col("s") / k - rest * rest / F.when(n > k, n - k)
    f = (whole - parts) / (parts / (n - 2))
    ok = t.where((k >= least) & (n - k >= least)).withColumn("f", f)
    return ok.groupBy(*by).agg(F.max_by("k", F.struct("f", -k)).alias("at"), F.max("f").alias("f"))


def ranks(df: DataFrame, column: str, by: Sequence[str] = (), method: str = "average", ascending: bool = True, order: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """average, min, max, first (by `order`) or dense."""
    w = W.partitionBy(*by).orderBy(F.col(column).asc() if ascending else F.col(column).desc())
    peers = F.count("*").over(W.partitionBy(*by, column))
    value = {
        "average": lambda: F.rank().over(w) + (peers - 1) / 2,
        "min": lambda: F.rank().over(w),
        "max": lambda: F.rank().over(w) + peers - 1,
        "first": lambda: F.row_number().over(W.partitionBy(*by).orderBy(F.col(column).asc() if ascending else F.col(column).desc(), *order)),
        "dense": lambda: F.dense_rank().over(w),
    }[method]()
    return df.withColumn(name, value)
