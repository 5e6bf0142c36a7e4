"""Scalers and power transforms: fit is one aggregate pass over the data, transform is column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.quantiles import exact_quantiles

STATISTICS = {
    "mean": lambda c: F.avg(c), "std": lambda c: F.stddev_pop(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c),
    "n": lambda c: F.count(c),
}
QUANTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75}


def column_stats(df: DataFrame, columns: Sequence[str], wanted: Sequence[str]) -> dict[str, dict[str, float]]:
    """One pass for all columns and statistics, and those of exact_quantiles where quantiles are wanted."""
    plain, at = [s for s in wanted if s in STATISTICS], [s for s in wanted if s in QUANTILES]
    row = df.agg(*(STATISTICS[s](F.col(c).cast("double")).alias(f"{c}|{s}") for c in columns for s in plain)).first() if plain else {}
    found = exact_quantiles(df, columns, [QUANTILES[s] for s in at]) if at else {}
    return {c: {s: row[f"{c}|{s}"] for s in plain} | dict(zip(at, found.get(c, []), strict=True)) for c in columns}


@dataclass(frozen=True)
class Affine:
    """x -> (x - shift) / scale * gain + offset for each column; invertible."""

    parts: dict[str, tuple[float, float, float, float]]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c + suffix: (F.col(c) - s) / k * g + o for c, (s, k, g, o) in self.parts.items()})

    def inverse(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c: (F.col(c + suffix) - o) / g * k + s for c, (s, k, g, o) in self.parts.items()})


def _or_one(x: float | None) -> float:
    return x or 1.0


def fit_standard(df: DataFrame, columns: Sequence[str], with_mean: bool = True, with_std: bool = True) -> Affine:
    """z with the population's deviation; a constant column is only centred."""
    st = column_stats(df, columns, ("mean", "std"))
    return Affine({c: (v["mean"] if with_mean else 0.0, _or_one(v["std"]) if with_std else 1.0, 1.0, 0.0) for c, v in st.items()})


def fit_min_max(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0) -> Affine:
    """To [low, high]; a constant column goes to low."""
    st = column_stats(df, columns, ("min", "max"))
    return Affine({c: (v["min"], _or_one(v["max"] - v["min"]), high - low, low) for c, v in st.items()})


def fit_max_abs(df: DataFrame, columns: Sequence[str]) -> Affine:
    st = column_stats(df, columns, ("min", "max"))
    return Affine({c: (0.0, _or_one(max(abs(v["min"]), abs(v["max"]))), 1.0, 0.0) for c, v in st.items()})


def fit_robust(df: DataFrame, columns: Sequence[str]) -> Affine:
    """Median and interquartile range."""
    st = column_stats(df, columns, ("median", "q25", "q75"))
    return Affine({c: (v["median"], _or_one(v["q75"] - v["q25"]), 1.0, 0.0) for c, v in st.items()})


def fit_pareto(df: DataFrame, columns: Sequence[str]) -> Affine:
    """Centred and divided by the square root of the population's variance."""
    return fit_standard(df, columns)


def z_outliers(df: DataFrame, column: str, threshold: float = 3.0, modified: bool = False, name: str = "is_outlier") -> DataFrame:
    """Flags |z| over the threshold; modified: 0.6745 (x - median) / MAD, the MAD taken in a second pass."""
    if not modified:
        s = column_stats(df, [column], ("mean", "std"))[column]
        z = (F.col(column) - s["mean"]) / (s["std"] or 1e-10)
    else:
        median = column_stats(df, [column], ("median",))[column]["median"]
        mad = exact_quantiles(df, {"gap": F.abs(F.col(column) - median)}, [0.5])["gap"][0]
        z = 0.6745 * (F.col(column) - median) / (mad or 1e-10)
    return df.withColumn(name, F.coalesce(F.abs(z) > threshold, F.lit(False)))


def iqr_outliers(df: DataFrame, column: str, k: float = 1.5, name: str = "is_outlier") -> DataFrame:
    s = column_stats(df, [column], ("q25", "q75"))[column]
    reach = k * (s["q75"] - s["q25"])
    return df.withColumn(name, F.coalesce((F.col(column) < s["q25"] - reach) | (F.col(column) > s["q75"] + reach), F.lit(False)))


def clip(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.withColumn(column, F.least(F.greatest(F.col(column), F.lit(low)), F.lit(high)))


def power(x: Column, p: float) -> Column:
    """sign(x) |x| ** p."""
    return F.signum(x) * F.pow(F.abs(x), F.lit(p))


def box_cox(x: Column, lam: float) -> Column:
    return F.when(x > 0, F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam)


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(F.greatest(x, F.lit(0.0))) if abs(lam) < 1e-12 else (F.pow(F.greatest(x, F.lit(0.0)) + 1, F.lit(lam)) - 1) / lam
    down_x = F.greatest(-x, F.lit(0.0))
    down = -F.log1p(down_x) if abs(lam - 2) < 1e-12 else -(F.pow(down_x + 1, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def fit_lambda(df: DataFrame, column: str, family: str = "yeo_johnson", low: float = -2.0, high: float = 2.0, steps: int = 81) -> float:
    """The likeliest lambda of a grid: all candidates' moments are taken in one pass."""
    x = F.col(column).cast("double")
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    f = {"yeo_johnson": yeo_johnson, "box_cox": box_cox}[family]
    logs = F.signum(x) * F.log1p(F.abs(x)) if family == "yeo_johnson" else F.log(x)
    kept = df if family == "yeo_johnson" else df.where(x > 0)
    row = kept.agg(F.count(x), F.sum(logs), *(F.var_pop(f(x, lam)) for lam in grid)).first()
    if not row[0]:
        return 1.0
    return max((-(row[0] / 2) * math.log(max(v, 1e-300)) + (lam - 1) * row[1], -abs(lam - 1), lam) for lam, v in zip(grid, row[2:], strict=True))[2]


def log_scaled(x: Column, base: float = math.e, add: float = 0.0) -> Column:
    """log of x + add; null where that is not positive."""
    return F.when(x + add > 0, F.log(x + add) / math.log(base))


def johnson_su(x: Column, gamma: float, delta: float, xi: float, lam: float) -> Column:
    return gamma + delta * F.asinh((x - xi) / lam)


def row_normalised(df: DataFrame, columns: Sequence[str], norm: str = "l2", suffix: str = "") -> DataFrame:
    """Each row divided by its norm; a zero norm divides by one."""
    xs = [F.col(c) for c in columns]
    total = {"l1": lambda: sum((F.abs(x) for x in xs), F.lit(0.0)), "l2": lambda: F.sqrt(sum((x * x for x in xs), F.lit(0.0))), "max": lambda: F.greatest(*(F.abs(x) for x in xs)) if len(xs) > 1 else F.abs(xs[0])}[norm]()
    by = F.when(total == 0, 1.0).otherwise(total)
    return df.withColumns({c + suffix: F.col(c) / by for c in columns})


def fit_adaptive(df: DataFrame, columns: Sequence[str], most_skew: float = 1.0, most_outliers: float = 0.01) -> tuple[Affine, dict[str, str]]:
    """Each column by what its values ask for: median and quartiles where more than `most_outliers` lie beyond 1.5 interquartile ranges, min and max where it leans
    (|skewness| over `most_skew`), else mean and deviation; and which was taken."""
    robust, spread = fit_robust(df, columns), column_stats(df, columns, ("q25", "q75"))
    far = {c: (spread[c]["q25"] - 1.5 * (spread[c]["q75"] - spread[c]["q25"]), spread[c]["q75"] + 1.5 * (spread[c]["q75"] - spread[c]["q25"])) for c in columns}
    row = df.agg(*(F.skewness(c) for c in columns), *(F.avg((~F.col(c).between(*far[c])).cast("double")) for c in columns)).first()
    plain, ends, parts, taken = fit_standard(df, columns), fit_min_max(df, columns), {}, {}
    for i, c in enumerate(columns):
        if (row[len(columns) + i] or 0) > most_outliers:
            parts[c], taken[c] = robust.parts[c], "robust"
        elif abs(row[i] or 0) > most_skew:
            parts[c], taken[c] = ends.parts[c], "min_max"
        else:
            parts[c], taken[c] = plain.parts[c], "standard"
    return Affine(parts), taken
