"""Feature construction, selection scores, geohashes and resampling."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.relational import pseudo_random


def polynomial(df: DataFrame, columns: Sequence[str], degree: int, interaction_only: bool = False) -> DataFrame:
    """Products of 2 to `degree` columns; with powers unless interactions only."""
    pick = combinations if interaction_only else combinations_with_replacement
    made = {}
    for d in range(2, degree + 1):
        for combo in pick(columns, d):
            x = F.col(combo[0])
            for c in combo[1:]:
                x = x * F.col(c)
            made["_x_".join(combo)] = x
    return df.withColumns(made)


def ratios(df: DataFrame, columns: Sequence[str], fill: float = 0.0) -> DataFrame:
    """x / y of every ordered pair; `fill` on a zero denominator."""
    return df.withColumns({f"{a}_per_{b}": F.when(F.col(b) != 0, F.col(a) / F.col(b)).otherwise(fill) for a, b in permutations(columns, 2)})


def rbf(df: DataFrame, column: str, centers: Sequence[float], gamma: float) -> DataFrame:
    return df.withColumns({f"{column}_rbf{i}": F.exp(-gamma * (F.col(column) - c) * (F.col(column) - c)) for i, c in enumerate(centers)})


def fisher_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(name, score): between-class over within-class variation of each column; one pass by class."""
    by = df.groupBy(label).agg(F.count("*").alias("__n"), *(e.alias(f"{c}|{k}") for c in columns for k, e in (("m", F.avg(c)), ("v", F.var_pop(c)))))
    n, w = F.col("__n"), W.partitionBy()
    cells = []
    for c in columns:
        m, v = F.col(f"`{c}|m`"), F.col(f"`{c}|v`")
        by = by.withColumn(f"{c}|g", F.sum(n * m).over(w) / F.sum(n).over(w))
        g = F.col(f"`{c}|g`")
        cells.append(F.struct(F.lit(c).alias("name"), (F.sum(n * (m - g) * (m - g)) / (F.sum(n * v) + 1e-12)).alias("score")))
    return by.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(name, f): the one-way analysis of variance of each column."""
    by = df.groupBy(label).agg(F.count("*").alias("__n"), *(e.alias(f"{c}|{k}") for c in columns for k, e in (("s", F.sum(c)), ("q", F.sum(F.col(c) * F.col(c))))))
    n = F.col("__n")
    cells = []
    for c in columns:
        s, q = F.col(f"`{c}|s`"), F.col(f"`{c}|q`")
        between = F.sum(s * s / n) - F.sum(s) * F.sum(s) / F.sum(n)
        within = F.sum(q) - F.sum(s * s / n)
        cells.append(F.struct(F.lit(c).alias("name"), ((between / (F.count("*") - 1)) / (within / (F.sum(n) - F.count("*")))).alias("f")))
    return by.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def chi2_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(name, chi2) of non-negative columns: class sums against those expected from class shares."""
    by = df.groupBy(label).agg(F.count("*").alias("__n"), *(F.sum(c).alias(c) for c in columns))
    w = W.partitionBy()
    cells = []
    share = F.col("__n") / F.sum("__n").over(w)
    for c in columns:
        by = by.withColumn(f"{c}|e", share * F.sum(c).over(w))
        gap = F.col(c) - F.col(f"`{c}|e`")
        cells.append(F.struct(F.lit(c).alias("name"), F.sum(gap * gap / F.col(f"`{c}|e`")).alias("chi2")))
    return by.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, variance) of the population."""
    row = df.agg(*(F.var_pop(c).alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("variance")) for c in columns))).alias("s")).select("s.*")


def uncorrelated(df: DataFrame, columns: Sequence[str], threshold: float) -> list[str]:
    """Columns that stay when the later one of each pair with |r| over the threshold goes."""
    from quarry.operators.statistics import correlation_pairs

    gone: set[str] = set()
    strong = {(r["a"], r["b"]) for r in correlation_pairs(df, columns).collect() if r["r"] is not None and abs(r["r"]) > threshold}
    for i, a in enumerate(columns):
        gone |= {b for b in columns[i + 1 :] if a not in gone and (a, b) in strong}
    return [c for c in columns if c not in gone]


def min_redundancy(df: DataFrame, columns: Sequence[str], label: str, k: int) -> list[str]:
    """Greedy: relevance F less the mean |r| with what is chosen (difference form). All numbers come from two passes."""
    from quarry.operators.statistics import correlation_pairs

    f = {r["name"]: r["f"] or 0.0 for r in anova_f(df, columns, label).collect()}
    top = max(f.values()) or 1.0
    r = {frozenset((x["a"], x["b"])): abs(x["r"] or 0.0) for x in correlation_pairs(df, columns).collect()}
    chosen: list[str] = []
    while len(chosen) < min(k, len(columns)):
        rest = [c for c in columns if c not in chosen]
        chosen.append(max(rest, key=lambda c: (f[c] / top - (sum(r[frozenset((c, d))] for d in chosen) / len(chosen) if chosen else 0), c)))
    return chosen


#: Fixed value: the digits of a geohash.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lon: Column, precision: int = 6) -> Column:
    """Bits of longitude and latitude in turn, five to a digit."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    cell = lambda x, lo, hi, n: F.least(F.floor((x - lo) / (hi - lo) * (1 << n)), F.lit((1 << n) - 1)).cast("long")
    a, b = cell(lon, -180.0, 180.0, n_lon), cell(lat, -90.0, 90.0, n_lat)

    def bit(i: int) -> Column:
        source, place = (a, n_lon - 1 - i // 2) if i % 2 == 0 else (b, n_lat - 1 - i // 2)
        return F.shiftright(source, place).bitwiseAND(F.lit(1).cast("long"))

    digits = [F.substring(F.lit(GEOHASH), (sum((bit(5 * d + j) * (1 << (4 - j)) for j in range(5)), F.lit(0).cast("long")) + 1).cast("int"), F.lit(1)) for d in range(precision)]
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.concat(*digits))


def undersampled(df: DataFrame, id_col: str, label: str, seed: int = 0) -> DataFrame:
    """Of each class as many rows as the smallest has, in a fixed random order."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0]
    place = F.row_number().over(W.partitionBy(label).orderBy(pseudo_random(id_col, seed), id_col))
    return df.withColumn("__n", place).where(F.col("__n") <= least).drop("__n")


def oversampled(df: DataFrame, id_col: str, label: str, seed: int = 0) -> DataFrame:
    """Smaller classes are topped up to the largest: whole copies, and the first rows of a random order once more."""
    sizes = df.groupBy(label).agg(F.count("*").alias("__c"))
    sizes = sizes.withColumn("__m", F.max("__c").over(W.partitionBy()))
    place = F.row_number().over(W.partitionBy(label).orderBy(pseudo_random(id_col, seed), id_col))
    t = df.withColumn("__p", place).join(sizes, label)
    copies = F.floor(F.col("__m") / F.col("__c")) + (F.col("__p") <= F.col("__m") % F.col("__c")).cast("long")
    return t.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("__p", "__c", "__m")


def aggregates_of_children(parent: DataFrame, child: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Deep feature synthesis of depth one: count, sum, mean, min, max and deviation of each child column."""
    made = [e.alias(f"{n}_{c}") for c in columns for n, e in (("sum", F.sum(c)), ("mean", F.avg(c)), ("min", F.min(c)), ("max", F.max(c)), ("std", F.stddev_pop(c)))]
    return parent.join(child.groupBy(key).agg(F.count("*").alias("n_children"), *made), key, "left")


def fourier_coefficients(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """(by, k, re, im, size) of each series: its sums against cosine and sine of 2 pi k t / n."""
    import math

    w = W.partitionBy(*by)
    t = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("x"), (F.row_number().over(w.orderBy(*order)) - 1).alias("t"), F.count("*").over(w).alias("n"))
    each = t.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    turn = 2 * math.pi * F.col("k") * F.col("t") / F.col("n")
    c = each.groupBy(*by, "k").agg(F.sum(F.col("x") * F.cos(turn)).alias("re"), (-F.sum(F.col("x") * F.sin(turn))).alias("im"))
    return c.withColumn("size", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))


def series_features(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each series: length, moments, energy, changes, runs about the mean, and where its extremes lie."""
    w = W.partitionBy(*by)
    x = F.col("x")
    t = df.where(F.col(column).isNotNull()).select(*by, *order, F.col(column).cast("double").alias("x"))
    t = t.withColumns({"d": x - F.lag("x").over(w.orderBy(*order)), "m": F.avg("x").over(w), "i": F.row_number().over(w.orderBy(*order)) - 1})
    t = t.withColumn("turn", ((x > F.col("m")) != F.lag(x > F.col("m")).over(w.orderBy(*order))).cast("int"))
    return t.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.sum(x * x).alias("energy"), F.avg(F.abs("d")).alias("mean_abs_change"), F.avg("d").alias("mean_change"),
        F.sum(F.abs("d")).alias("path"), F.count_if(x > F.col("m")).alias("above_mean"), F.coalesce(F.sum("turn"), F.lit(0)).alias("crossings"), F.max("x").alias("highest"), F.min("x").alias("lowest"),
        (F.min_by("i", F.struct(-x, F.col("i"))) / F.count("*")).alias("first_highest"), (F.min_by("i", F.struct(x, F.col("i"))) / F.count("*")).alias("first_lowest"),
    )


def differences_along(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(by, climb, fall, net): sums of a column's rises and falls along each path, as of elevations."""
    d = F.col(column) - F.lag(column).over(W.partitionBy(*by).orderBy(*order))
    t = df.select(*by, d.alias("d"))
    return t.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0.0)).alias("climb"), F.coalesce(-F.sum(F.when(F.col("d") < 0, F.col("d"))), F.lit(0.0)).alias("fall"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("net"))


def probability_integral(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """The column's place in its own distribution: (average rank - 0.5) / n."""
    from quarry.operators.statistics import average_ranks

    n = df.where(F.col(column).isNotNull()).count()
    return average_ranks(df, column, name="__r").withColumn(name or f"{column}_pit", (F.col("__r") - 0.5) / n).drop("__r")


def skewness_corrected(df: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> tuple[DataFrame, dict[str, str]]:
    """Columns whose skewness passes the threshold become ln(1 + x - least), or its mirror image where they lean the other way; and what was done."""
    row = df.agg(*(F.skewness(c) for c in columns), *(F.min(c).cast("double") for c in columns), *(F.max(c).cast("double") for c in columns)).first()
    k, made, done = len(columns), {}, {}
    for i, c in enumerate(columns):
        skew, low, high = row[i], row[k + i], row[2 * k + i]
        if skew is not None and abs(skew) > threshold:
            made[c] = F.log1p(F.col(c) - low) if skew > 0 else -F.log1p(high - F.col(c))
            done[c] = "log" if skew > 0 else "mirrored log"
    return (df.withColumns(made) if made else df), done


def independent_components(df: DataFrame, columns: Sequence[str], k: int, rounds: int = 100, tolerance: float = 1e-6, seed: int = 0):
    """Means and an unmixing matrix (k, columns) by fixed-point steps on whitened columns (tanh contrast); each step is one aggregate of k * (columns + 1) sums."""
    import numpy as np

    from quarry.operators.statistics import factor_covariance

    means, cov = factor_covariance(df, columns)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(-values)[:k]
    white = (vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-300))).T
    rows = df.select(*columns).dropna()
    z = [sum((float(white[i, j]) * (F.col(c) - float(means[j])) for j, c in enumerate(columns)), F.lit(0.0)) for i in range(k)]
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, k)))[0]
    whitened = rows.select(*(e.alias(f"z{i}") for i, e in enumerate(z)))
    for _ in range(rounds):
        t = [F.tanh(sum((float(w[a, i]) * F.col(f"z{i}") for i in range(k)), F.lit(0.0))) for a in range(k)]
        row = whitened.agg(*(F.avg(t[a] * F.col(f"z{i}")) for a in range(k) for i in range(k)), *(F.avg(1 - x * x) for x in t)).first()
        new = np.array(row[: k * k], float).reshape(k, k) - np.array(row[k * k :], float)[:, None] * w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < tolerance
        w = new
        if done:
            break
    return means, w @ white


def interactions_by_gain(df: DataFrame, columns: Sequence[str], target: str, k: int) -> list[tuple[str, str, float]]:
    """The k products of two columns that correlate most with what a linear fit leaves of the target."""
    from quarry.operators.models import fit_linear

    rows = df.select(*columns, target).dropna()
    left = fit_linear(rows, columns, target).predict(rows, "__p").withColumn("__e", F.col(target) - F.col("__p"))
    pairs = list(combinations_with_replacement(columns, 2))
    row = left.agg(*(F.corr(F.col(a) * F.col(b), F.col("__e")) for a, b in pairs)).first()
    found = [(a, b, float(abs(r))) for (a, b), r in zip(pairs, row, strict=True) if r is not None and r == r]
    return sorted(found, key=lambda x: (-x[2], x[0], x[1]))[:k]


def without_collinear(df: DataFrame, columns: Sequence[str], most: float = 10.0) -> list[str]:
    """Columns left when, each time, the one of largest variance inflation over `most` goes; all numbers come from one pass."""
    import numpy as np

    from quarry.operators.statistics import factor_covariance

    _, cov = factor_covariance(df, columns)
    sd = np.sqrt(np.diag(cov))
    r, kept = cov / np.outer(sd, sd), list(range(len(columns)))
    while len(kept) > 1:
        inflation = np.diag(np.linalg.inv(r[np.ix_(kept, kept)] + 1e-9 * np.eye(len(kept))))
        worst = int(inflation.argmax())
        if inflation[worst] <= most:
            break
        kept.pop(worst)
    return [columns[i] for i in kept]


def voronoi(df: DataFrame, x: Column, y: Column, seeds: Sequence[tuple[float, float]], name: str = "cell") -> DataFrame:
    """The position of the nearest seed, the first of equal ones."""
    from quarry.operators.clusters import nearest_place

    return df.withColumn(name, nearest_place([(x - a) * (x - a) + (y - b) * (y - b) for a, b in seeds]))
