"""Summaries and hypothesis tests. Sums over rows are aggregates or windows; the last step of a test is arithmetic on a few numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import NumericType

from quarry.functions import special
from quarry.operators.quantiles import exact_quantiles
from quarry.operators.relational import dense_number, running_sums


def summary(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = (0.25, 0.5, 0.75), sample_std: bool = False) -> DataFrame:
    """A row for each column: count, mean, std, min, max, in one pass, and exact quantiles."""
    found = exact_quantiles(df, columns, quantiles)

    def one(c: str) -> list[Column]:
        x = F.col(c).cast("double")
        std = F.stddev_samp(x) if sample_std else F.stddev_pop(x)
        return [F.count(x), F.avg(x), std, F.min(x), F.max(x), *(F.lit(q).cast("double") for q in found[c])]

    names = ["n", "mean", "std", "min", "max", *(f"q{round(q * 100)}" for q in quantiles)]
    cell = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), *(F.col(f"`{c}|{n}`").cast("double").alias(n) for n in names)) for c in columns)))
    return df.agg(*(e.alias(f"{c}|{n}") for c in columns for e, n in zip(one(c), names, strict=True))).select(cell.alias("s")).select("s.*")


def moments(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, std (population), skew = m3 n / ((n - 1)(n - 2)) and excess kurtosis of the standardised values; a constant column gives 0 and -3."""
    x = F.col(column).cast("double")
    m = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.skewness(x).alias("m3"), F.kurtosis(x).alias("m4"))
    n, flat = F.col("n"), F.col("std") == 0
    skew = F.when(flat, 0.0).otherwise(F.col("m3")) * n * n / ((n - 1) * (n - 2))
    return m.select(*by, "n", "mean", "std", F.when(n > 2, skew).alias("skew"), F.when(flat, -3.0).otherwise(F.col("m4")).alias("kurtosis"))


def median_absolute_deviation(df: DataFrame, column: str, center: float | None = None) -> float:
    x = F.col(column).cast("double")
    if center is None:
        center = exact_quantiles(df, [column], [0.5])[column][0]
    return exact_quantiles(df, {"gap": F.abs(x - center)}, [0.5])["gap"][0]


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Ranks from 1, ties averaged. Equal values are counted first, so the running count sees each distinct value once."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__t"))
    if by or not isinstance(df.schema[value].dataType, NumericType):
        before = F.sum("__t").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1))
        placed = counts.withColumn("__before", F.coalesce(before, F.lit(0)))
    else:
        placed = running_sums(counts, value, {"__before": "__t"})
    return df.join(placed.withColumn(name, F.col("__before") + (F.col("__t") + 1) / 2).drop("__t", "__before"), [*by, value])


def pearson(df: DataFrame, x: str, y: str) -> dict[str, float]:
    n, r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*"), F.corr(x, y)).first()
    t = r * math.sqrt((n - 2) / max(1e-300, 1 - r * r))
    return {"n": n, "r": r, "t": t, "p": special.t_sf2(t, n - 2)}


def spearman(df: DataFrame, x: str, y: str) -> dict[str, float]:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return pearson(average_ranks(average_ranks(both, x, name="__x"), y, name="__y"), "__x", "__y")


def two_sample_t(df: DataFrame, value: str, group: str, a: object, b: object, equal_var: bool = False) -> dict[str, float]:
    """Welch's test, or Student's with a common variance."""
    rows = {r[0]: r[1:] for r in df.where(F.col(group).isin(a, b)).groupBy(group).agg(F.count(value), F.avg(value), F.var_samp(value)).collect()}
    (n1, m1, v1), (n2, m2, v2) = rows[a], rows[b]
    if equal_var:
        freedom = n1 + n2 - 2
        se = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / freedom * (1 / n1 + 1 / n2))
    else:
        p, q = v1 / n1, v2 / n2
        se, freedom = math.sqrt(p + q), (p + q) ** 2 / (p * p / (n1 - 1) + q * q / (n2 - 1))
    t = (m1 - m2) / se
    return {"t": t, "df": freedom, "p": special.t_sf2(t, freedom)}


def paired_t(df: DataFrame, x: str, y: str) -> dict[str, float]:
    n, m, s = df.agg(F.count(F.col(x) - F.col(y)), F.avg(F.col(x) - F.col(y)), F.stddev_samp(F.col(x) - F.col(y))).first()
    t = m / (s / math.sqrt(n))
    return {"n": n, "t": t, "d": m / s, "p": special.t_sf2(t, n - 1)}


def ks_two_sample(df: DataFrame, value: str, is_first: Column) -> DataFrame:
    """(n1, n2, d): the largest gap of the two distribution functions, from counts of distinct values."""
    t = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(is_first).alias("a"), F.count_if(~is_first).alias("b"))
    total = t.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    placed = running_sums(t, value, {"lo_a": "a", "lo_b": "b"}).crossJoin(F.broadcast(total))
    gap = F.abs((F.col("lo_a") + F.col("a")) / F.col("n1") - (F.col("lo_b") + F.col("b")) / F.col("n2"))
    return placed.groupBy("n1", "n2").agg(F.max(gap).alias("d"))


def ks_p_value(d: float, n1: int, n2: int) -> float:
    """Kolmogorov's limit law."""
    en = math.sqrt(n1 * n2 / (n1 + n2))
    lam = (en + 0.12 + 0.11 / en) * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))


def chi_square_independence(df: DataFrame, row: str, column: str, yates: bool = False) -> DataFrame:
    """(n, chi2, df, contingency) from the table of counts."""
    t = df.groupBy(row, column).agg(F.count("*").alias("o"))
    cells = t.select(row).distinct().crossJoin(t.select(column).distinct()).join(t, [row, column], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    e = F.sum("o").over(W.partitionBy(row)) * F.sum("o").over(W.partitionBy(column)) / F.sum("o").over(W.partitionBy())
    gap = F.greatest(F.abs(F.col("o") - F.col("e")) - (0.5 if yates else 0.0), F.lit(0.0))
    out = cells.withColumn("e", e).agg(F.sum("o").alias("n"), F.sum(gap * gap / F.col("e")).alias("chi2"), ((F.count_distinct(row) - 1) * (F.count_distinct(column) - 1)).alias("df"))
    return out.withColumn("contingency", F.sqrt(F.col("chi2") / (F.col("chi2") + F.col("n"))))


def tied(df: DataFrame, value: str) -> DataFrame:
    """(ties): the sum of t ** 3 - t over the counts of equal values, as a double: cubes of counts pass the range of a long from two million rows on."""
    t = F.col("t").cast("decimal(38,0)")
    return df.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(t * t * t - t).cast("double").alias("ties"))


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """(n, k, h): H on average ranks, divided by the correction for ties."""
    ranked = average_ranks(df.select(value, group), value)
    ties = tied(df, value)
    sums = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum("rank").alias("r"))
    total = sums.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s")).crossJoin(ties)
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return total.select("n", "k", h.alias("h"))


def wilcoxon_signed_rank(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, w_plus, w_minus, z): zeros dropped, average ranks, normal approximation with continuity and tie correction."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).where("d <> 0").withColumn("a", F.abs("d"))
    ties = tied(d, "a")
    ranked = average_ranks(d, "a")
    t = ranked.agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus")).crossJoin(ties)
    n = F.col("n").cast("double")
    gap = F.col("w_plus") - n * (n + 1) / 4
    z = (gap - F.signum(gap) * 0.5) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return t.select("n", "w_plus", "w_minus", z.alias("z"))


def anderson_darling_normal(df: DataFrame, value: str) -> DataFrame:
    """(n, a2, a2_adjusted) against the normal law of the sample's mean and deviation.

    Equal values are grouped: the i-th of n enters with weights 2 i - 1, so a run from i to j has the sum j * j - (i - 1) ** 2.
    """
    x = F.col(value).cast("double")
    st = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    t = running_sums(df.where(x.isNotNull()).groupBy(x.alias("x")).agg(F.count("*").alias("c")), "x", {"lo": "c"}).withColumn("hi", F.col("lo") + F.col("c")).crossJoin(F.broadcast(st))
    p = F.greatest(F.least(special.norm_cdf((F.col("x") - F.col("m")) / F.col("s")), F.lit(1 - 1e-12)), F.lit(1e-12))
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    up = hi * hi - lo * lo  # the sum of 2 i - 1 over the run
    down = F.col("c") * 2 * n - up  # of 2 (n - i) + 1
    a2 = -n - F.sum(up * F.log(p) + down * F.log(1 - p)) / n
    out = t.groupBy("n").agg(a2.alias("a2"))
    return out.withColumn("a2_adjusted", F.col("a2") * (1 + F.lit(0.75) / n + F.lit(2.25) / (n * n)))


def sign_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, positive, median_difference); zeros dropped."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).where("d <> 0")
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("positive"), F.percentile("d", F.lit(0.5)).alias("median_difference"))


def mean_interval(df: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """Normal interval of the mean."""
    z = special.norm_ppf(0.5 + level / 2)
    t = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"))
    half = z * F.col("s") / F.sqrt("n")
    return t.select("n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def adjusted_p_values(df: DataFrame, p: str, method: str = "bh") -> DataFrame:
    """Benjamini-Hochberg (the least p from the top, times m over the rank, at most 1), or Bonferroni."""
    if method == "bonferroni":
        return df.withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * F.count("*").over(W.partitionBy())))
    known = df.where(F.col(p).isNotNull())
    total = known.agg(F.count("*").alias("__m"))
    placed = dense_number(known, [p], "__rank").crossJoin(F.broadcast(total))
    return placed.withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * F.col("__m") / (F.col("__rank") + 1))).drop("__rank", "__m")


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, float]]:
    """1 / (1 - R squared) of each column on the others: the diagonal of the inverse correlation matrix, from one pass of pair sums."""
    import numpy as np

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.corr(a, b) for a, b in pairs)).first()
    m = np.eye(len(columns))
    for (a, b), r in zip(pairs, row, strict=True):
        i, j = columns.index(a), columns.index(b)
        m[i, j] = m[j, i] = r
    return [(c, float(v)) for c, v in zip(columns, np.diag(np.linalg.pinv(m)), strict=True)]


def normal_posterior(df: DataFrame, value: str, prior_mean: float, prior_var: float, noise_var: float) -> DataFrame:
    """Conjugate update of a normal mean."""
    t = df.agg(F.count(value).alias("n"), F.avg(value).alias("m"))
    var = 1 / (F.lit(1 / prior_var) + F.col("n") / noise_var)
    return t.select("n", (var * (F.lit(prior_mean / prior_var) + F.col("n") * F.col("m") / noise_var)).alias("mean"), var.alias("variance"))


def gaussian_bic(df: DataFrame, value: str, penalty: float = 1.0) -> DataFrame:
    """-2 ln L + k ln n of a normal law fitted by its moments."""
    t = df.agg(F.count(value).alias("n"), F.var_pop(value).alias("v"))
    return t.select("n", (F.col("n") * (F.log(2 * math.pi * F.col("v")) + 1) + 2 * F.log("n") * penalty).alias("bic"))


def entropy(df: DataFrame, columns: Sequence[str], base: float = 2.0) -> DataFrame:
    """Shannon's entropy of the joint values."""
    t = df.groupBy(*columns).agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(W.partitionBy()))
    return t.agg((-F.sum(F.col("p") * F.log("p")) / math.log(base)).alias("entropy"))


def conditional_entropy(df: DataFrame, x: str, y: str, base: float = 2.0) -> DataFrame:
    """H(y | x), and their mutual information."""
    t = df.groupBy(x, y).agg(F.count("*").alias("c"))
    n = F.sum("c").over(W.partitionBy())
    p, px, py = F.col("c") / n, F.sum("c").over(W.partitionBy(x)) / n, F.sum("c").over(W.partitionBy(y)) / n
    t = t.withColumn("h", -p * F.log(p / px)).withColumn("i", p * F.log(p / (px * py)))
    return t.agg((F.sum("h") / math.log(base)).alias("conditional_entropy"), (F.sum("i") / math.log(base)).alias("mutual_information"))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of every pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))).alias("s")).select("s.*")


def factor_covariance(df: DataFrame, columns: Sequence[str]):
    """(means, covariance) on the driver: as many numbers as there are pairs of columns, from one pass."""
    import numpy as np

    k = len(columns)
    df = df.select(*(F.col(c).cast("double").alias(c) for c in dict.fromkeys(columns))).dropna()  # all sums over the same rows
    row = df.agg(*(F.avg(c) for c in columns), *(F.covar_samp(a, b) for i, a in enumerate(columns) for b in columns[i:])).first()
    means, rest, cov = np.array(row[:k], float), iter(row[k:]), np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = next(rest)
    return means, cov


def mahalanobis(df: DataFrame, columns: Sequence[str], name: str = "distance") -> DataFrame:
    """Distance from the mean under the pseudo-inverse of the sample covariance, as one expression."""
    import numpy as np

    means, cov = factor_covariance(df, columns)
    inv = np.linalg.pinv(cov)
    d = [F.col(c) - float(m) for c, m in zip(columns, means, strict=True)]
    total = sum((d[i] * d[j] * float(inv[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return df.withColumn(name, F.sqrt(F.greatest(total, F.lit(0.0))))
