"""Evaluation metrics and losses: each is one aggregate over (y, p)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regression(y: Column, p: Column) -> dict[str, Column]:
    """Aggregates to be used in one agg()."""
    e = y - p
    return {
        "mae": F.avg(F.abs(e)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "median_ae": F.percentile(F.abs(e), F.lit(0.5)),
        "r2": 1 - F.sum(e * e) / (F.var_pop(y) * F.count(y)),
        "explained_variance": 1 - F.var_pop(e) / F.var_pop(y),
        "nmse": F.avg(e * e) / F.var_pop(y),
        "theil_u": F.sqrt(F.avg(e * e)) / (F.sqrt(F.avg(y * y)) + F.sqrt(F.avg(p * p))),
        "mape": F.avg(F.abs(e) / F.when(y != 0, F.abs(y))),
        "smape": F.avg(2 * F.abs(e) / F.when(F.abs(y) + F.abs(p) != 0, F.abs(y) + F.abs(p))),
    }


def regression_scores(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """One row of the metrics above; the median of errors is an exact quantile of bounded memory, the others share one pass."""
    from quarry.operators.quantiles import exact_quantiles

    middle = exact_quantiles(df, {"e": F.abs(y - p)}, [0.5])["e"][0]
    return df.agg(*((F.lit(middle).cast("double") if k == "median_ae" else v).alias(k) for k, v in regression(y, p).items()))


def log_error(y: Column, p: Column, eps: float = 1e-8) -> Column:
    """Mean of (ln(y + eps) - ln(p + eps)) squared."""
    d = F.log(y + eps) - F.log(p + eps)
    return F.avg(d * d)


def tweedie_deviance(y: Column, p: Column, power: float) -> Column:
    """Mean deviance; power 1 is Poisson's and 2 the gamma law's."""
    if power == 1:
        return 2 * F.avg(F.when(y > 0, y * F.log(y / p)).otherwise(0.0) - y + p)
    if power == 2:
        return 2 * F.avg(F.log(p / y) + y / p - 1)
    a, b = 1 - power, 2 - power
    return 2 * F.avg(F.pow(F.greatest(y, F.lit(0.0)), F.lit(b)) / (a * b) - y * F.pow(p, F.lit(a)) / a + F.pow(p, F.lit(b)) / b)


def cross_entropy(y: Column, p: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))


def dice_loss(y: Column, p: Column, smooth: float = 1.0) -> Column:
    return 1 - (2 * F.sum(y * p) + smooth) / (F.sum(y) + F.sum(p) + smooth)


def tversky_loss(y: Column, p: Column, alpha: float, beta: float, smooth: float = 1.0) -> Column:
    tp = F.sum(y * p)
    return 1 - (tp + smooth) / (tp + alpha * F.sum((1 - y) * p) + beta * F.sum(y * (1 - p)) + smooth)


def contrastive_loss(y: Column, d: Column, margin: float) -> Column:
    gap = F.greatest(margin - d, F.lit(0.0))
    return F.avg(0.5 * (y * d * d + (1 - y) * gap * gap))


def triplet_loss(near: Column, far: Column, margin: float) -> Column:
    """Squared distances to the positive and to the negative."""
    return F.avg(F.greatest(near - far + margin, F.lit(0.0)))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of 0/1 columns."""
    t = df.agg(*(F.count_if((F.col(y) == a) & (F.col(p) == b)).alias(n) for a, b, n in ((1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn"))))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return t.select("tp", "fp", "fn", "tn", one(tp + tn, tp + fp + fn + tn).alias("accuracy"), one(tp, tp + fp).alias("precision"), one(tp, tp + fn).alias("recall"), one(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve from counts of distinct scores: a positive beats lower negatives, and ties count half."""
    from quarry.operators.relational import running_sums

    t = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(y) == 1).alias("a"), F.count_if(F.col(y) == 0).alias("b"))
    placed = running_sums(t, score, {"below": "b"})
    return placed.withColumn("won", F.col("a") * (F.col("below") + F.col("b") / 2)).agg((F.sum("won") / (F.sum("a") * F.sum("b"))).alias("auc"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance: 2 R atan2(sqrt(a), sqrt(1 - a))."""
    rad = math.pi / 180
    a = F.pow(F.sin((lat2 - lat1) * rad / 2), 2) + F.cos(lat1 * rad) * F.cos(lat2 * rad) * F.pow(F.sin((lon2 - lon1) * rad / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))
