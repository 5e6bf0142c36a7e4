"""Discretisation: edges come from one aggregate pass, bins are expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.quantiles import exact_quantiles


def equal_width_edges(df: DataFrame, column: str, n: int) -> list[float]:
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    return [lo + (hi - lo) * i / n for i in range(n)] + [hi]


def quantile_edges(df: DataFrame, column: str, n: int, exact: bool = True) -> list[float]:
    """Distinct quantiles at i / n; exact ones take three passes, approximate ones one."""
    at = [i / n for i in range(n + 1)]
    if exact:
        return sorted({v for v in exact_quantiles(df, [column], at)[column] if v is not None})
    return sorted(set(df.agg(F.percentile_approx(F.col(column).cast("double"), at, 100_000)).first()[0] or []))


def digitize(x: Column, edges: Sequence[float], right: bool = False) -> Column:
    """Bin number from 0: left-closed, or right-closed; values beyond the ends go to the end bins."""
    if len(edges) > 40:  # a deep chain of cases would not compile
        inner = F.array(*(F.lit(float(e)) for e in edges[1:-1]))
        passed = F.filter(inner, lambda e: x > e) if right else F.filter(inner, lambda e: x >= e)
        return F.when(x.isNotNull(), F.size(passed))
    out = F.lit(0)
    for i, e in enumerate(edges[1:-1], start=1):
        out = F.when(x > e if right else x >= e, i).otherwise(out)
    return F.when(x.isNotNull(), out)


def entropy_edges(df: DataFrame, column: str, max_bins: int) -> list[float]:
    """Equal-count cuts of 2 to max_bins bins; the number of least description length (cuts * log2 n - sum of c log2 p) wins."""
    best = None
    for n in range(2, max_bins + 1):
        edges = quantile_edges(df, column, n)
        counts = [r[0] for r in df.groupBy(digitize(F.col(column), edges)).count().select("count").collect()]
        total = sum(counts)
        cost = (len(edges) - 2) * math.log2(max(total, 2)) - sum(c * math.log2(c / total) for c in counts if c)
        if best is None or cost < best[0]:
            best = (cost, edges)
    return best[1]


def chi_merge_edges(df: DataFrame, column: str, label: str, max_intervals: int, critical: float) -> list[float]:
    """Adjacent intervals of least chi-square are merged while it is at most `critical` or intervals are too many.

    Each distinct value is an interval at first, so the driver holds the class counts of all distinct values.
    """
    rows = df.groupBy(F.col(column).cast("double").alias("value"), F.col(label).alias("label")).count().where("value IS NOT NULL").collect()
    classes = sorted({r["label"] for r in rows}, key=str)
    place, of = {c: j for j, c in enumerate(classes)}, {}
    for r in rows:
        of.setdefault(r["value"], [0] * len(classes))[place[r["label"]]] += r["count"]
    values = sorted(of, key=lambda v: (v != v, v))  # not-a-number last, as in Spark
    counts, edges = [of[v] for v in values], values + values[-1:]

    def chi2(a: list[int], b: list[int]) -> float:
        total = sum(a) + sum(b)
        out = 0.0
        for row in (a, b):
            for j in range(len(classes)):
                expected = sum(row) * (a[j] + b[j]) / total if total else 0
                out += (row[j] - expected) ** 2 / expected if expected else 0
        return out

    cuts = list(edges)
    scores = [chi2(a, b) for a, b in zip(counts, counts[1:], strict=False)]
    while len(counts) > 1:
        i = min(range(len(scores)), key=scores.__getitem__)
        if scores[i] > critical and len(counts) <= max_intervals:
            break
        counts[i] = [a + b for a, b in zip(counts[i], counts.pop(i + 1), strict=True)]
        cuts.pop(i + 1)
        scores.pop(i)
        for j in range(max(0, i - 1), min(len(scores), i + 1)):
            scores[j] = chi2(counts[j], counts[j + 1])
    return cuts


def bin_statistics(df: DataFrame, bin_col: str, target: str) -> DataFrame:
    """(bin, n, events, woe, iv) of a 0/1 target, half a count added to each cell."""
    t = df.groupBy(bin_col).agg(F.count("*").alias("n"), F.sum(F.col(target).cast("double")).alias("events"))
    from pyspark.sql import Window as W

    w = W.partitionBy()
    good = (F.col("n") - F.col("events") + 0.5) / (F.sum(F.col("n") - F.col("events")).over(w) + 0.5)
    bad = (F.col("events") + 0.5) / (F.sum("events").over(w) + 0.5)
    return t.withColumn("woe", F.log(good / bad)).withColumn("iv", (good - bad) * F.log(good / bad))
