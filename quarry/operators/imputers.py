"""Imputation by models of the other columns. What is fitted are means and covariances, from aggregates; filling is expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.cleaning import fill, fit_means
from quarry.operators.statistics import factor_covariance


def by_regression(df: DataFrame, columns: Sequence[str], rounds: int = 3) -> DataFrame:
    """Chained least squares: gaps start at the means, then each column's gaps are predicted from the others, in rounds."""
    cols = list(columns)
    known = df.withColumns({f"__k_{c}": F.col(c).isNotNull() for c in cols})
    now = fill(known, fit_means(df, cols))
    for _ in range(rounds):
        for c in cols:
            others = [o for o in cols if o != c]
            means, cov = factor_covariance(now.where(f"__k_{c}"), [*others, c])
            w = np.linalg.pinv(cov[:-1, :-1]) @ cov[:-1, -1]
            guess = sum((F.col(o) * float(a) for o, a in zip(others, w, strict=True)), F.lit(float(means[-1] - means[:-1] @ w)))
            now = now.withColumn(c, F.when(F.col(f"__k_{c}"), F.col(c)).otherwise(guess))
    return now.drop(*(f"__k_{c}" for c in cols))


def normal_moments(df: DataFrame, columns: Sequence[str], rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a normal law by expectation-maximisation over rows with gaps.

    Rows are summed up by their pattern of gaps: counts, means and cross products of what is known are all that a round needs.
    """
    cols, k = list(columns), len(columns)
    code = sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(cols)), F.lit(0))
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
    sums = df.groupBy(code.alias("p")).agg(F.count("*"), *(F.sum(v) for v in x), *(F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k))).collect()
    groups = []
    for r in sums:
        cross, at = np.zeros((k, k)), iter(r[2 + k :])
        for i in range(k):
            for j in range(i, k):
                cross[i, j] = cross[j, i] = next(at)
        groups.append((int(r[0]), int(r[1]), np.array(r[2 : 2 + k], float), cross))
    total = sum(g[1] for g in groups)
    start = fit_means(df, cols)
    mean = np.array([start[c] for c in cols])
    cov = np.diag([float(v or 1.0) for v in df.agg(*(F.var_pop(c) for c in cols)).first()])
    for _ in range(rounds):
        s, q = np.zeros(k), np.zeros((k, k))
        for p, n, first, cross in groups:
            gone = [i for i in range(k) if p >> i & 1]
            have = [i for i in range(k) if not p >> i & 1]
            # A row's guess is linear in what is known: a x + b.
            a, b, rest = np.eye(k), np.zeros(k), np.zeros((k, k))
            if gone:
                a[np.ix_(gone, range(k))] = 0
                w = cov[np.ix_(gone, have)] @ np.linalg.pinv(cov[np.ix_(have, have)]) if have else np.zeros((len(gone), 0))
                a[np.ix_(gone, have)] = w
                b[gone] = mean[gone] - w @ mean[have]
                rest[np.ix_(gone, gone)] = cov[np.ix_(gone, gone)] - w @ cov[np.ix_(have, gone)]
            moved = a @ first
            s += moved + n * b
            q += a @ cross @ a.T + np.outer(moved, b) + np.outer(b, moved) + n * (np.outer(b, b) + rest)
        mean = s / total
        cov = q / total - np.outer(mean, mean)
    return mean, cov


def by_normal_law(df: DataFrame, columns: Sequence[str], rounds: int = 30) -> DataFrame:
    """Gaps become their expectation given the row's known columns; one expression for each pattern of gaps, so for few columns."""
    cols, k = list(columns), len(columns)
    mean, cov = normal_moments(df, cols, rounds)
    code = sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(cols)), F.lit(0))
    out = {}
    for i, c in enumerate(cols):
        guess = F.lit(float(mean[i]))
        for p in range(1 << k):
            have = [j for j in range(k) if not p >> j & 1]
            if p >> i & 1 and have:
                w = cov[i, have] @ np.linalg.pinv(cov[np.ix_(have, have)])
                value = sum((F.col(cols[j]) * float(v) for j, v in zip(have, w, strict=True)), F.lit(float(mean[i] - w @ mean[have])))
                guess = F.when(F.col("__p") == p, value).otherwise(guess)
        out[c] = F.coalesce(F.col(c).cast("double"), guess)
    return df.withColumn("__p", code).withColumns(out).drop("__p")


def complete_matrix(wide: pd.DataFrame, shrink: float = 1.0, rounds: int = 100) -> pd.DataFrame:
    """Soft-thresholded singular values of a matrix that fits the driver; known cells stay."""
    x = wide.to_numpy(float)
    known = ~np.isnan(x)
    z = np.where(known, x, 0.0)
    for _ in range(rounds):
        u, s, v = np.linalg.svd(np.where(known, x, z), full_matrices=False)
        new = (u * np.maximum(s - shrink, 0)) @ v
        if np.linalg.norm(new - z) <= 1e-6 * max(1.0, np.linalg.norm(z)):
            break
        z = new
    return pd.DataFrame(np.where(known, x, z), index=wide.index, columns=wide.columns)


def factorised(cells: DataFrame, rank: int = 5, penalty: float = 0.1) -> DataFrame:
    """(i, j, v) cells of a large sparse matrix -> the model's value beside each, by alternating least squares."""
    from pyspark.ml.recommendation import ALS

    t = cells.select(F.col("i").cast("int"), F.col("j").cast("int"), F.col("v").cast("float"))
    model = ALS(userCol="i", itemCol="j", ratingCol="v", rank=rank, regParam=penalty, seed=1, coldStartStrategy="drop").fit(t)
    return model.transform(t)


def multiple(df: DataFrame, id_col: str, columns: Sequence[str], draws: int = 5, rounds: int = 3) -> list[DataFrame]:
    """Several completed tables: gaps get their regression value and a normal residual of the fit's deviation, drawn by the hash of the id, so that tables differ as much as
    what is missing leaves open. See regressors.pooled."""
    from quarry.operators.regressors import unit

    out = []
    filled = by_regression(df, columns, rounds)
    named = filled.select(id_col, *(F.col(c).alias(f"__v_{c}") for c in columns))
    joined = df.join(named, id_col)
    spread = {}
    for c in columns:
        others = [o for o in columns if o != c]
        means, cov = factor_covariance(df.where(F.col(c).isNotNull()).join(named, id_col).select(*(F.col(f"__v_{o}").alias(o) for o in others), c), [*others, c])
        b = cov[:-1, -1]
        spread[c] = float(np.sqrt(max(0.0, cov[-1, -1] - b @ np.linalg.pinv(cov[:-1, :-1]) @ b)))
    for d in range(draws):
        made = {}
        for i, c in enumerate(columns):
            # Two uniform numbers make one normal one.
            u, v = (unit(id_col, 7919 * d + 31 * i + s) for s in (1, 2))
            normal = F.sqrt(-2 * F.log(u + 1e-18)) * F.cos(2 * np.pi * v)
            made[c] = F.coalesce(F.col(c), F.col(f"__v_{c}") + spread[c] * normal)
        out.append(joined.withColumns(made).drop(*(f"__v_{c}" for c in columns)))
    return out


def chains_agree(means: Sequence[Sequence[float]], variances: Sequence[Sequence[float]], most: float = 1.1) -> tuple[float, bool]:
    """The potential scale reduction of several chains of estimates (rows), and whether it is near one; variances are those within each estimate's table."""
    m, n = len(means), len(means[0])
    own = np.array(means, float)
    between = n * own.mean(axis=1).var(ddof=1) if m > 1 else 0.0
    within = float(own.var(axis=1, ddof=1).mean()) if n > 1 else float(np.mean(variances))
    ratio = float(np.sqrt(((n - 1) / n * within + between / n) / within)) if within else 1.0
    return ratio, ratio <= most


def by_trees(df: DataFrame, columns: Sequence[str], rounds: int = 2, trees: int = 10, depth: int = 5) -> DataFrame:
    """Chained random forests: gaps start at the means, then each column's gaps are predicted from the others. Each step's table is written, so plans do not grow."""
    from quarry.operators._store import stored
    from quarry.operators.models import assembled, fit_ml

    cols = list(columns)
    known = df.withColumns({f"__k_{c}": F.col(c).isNotNull() for c in cols})
    gaps = df.agg(*(F.count_if(F.col(c).isNull()) for c in cols)).first()
    now = stored(fill(known.withColumns({c: F.col(c).cast("double") for c in cols}), fit_means(df, cols)), "filled")
    for _ in range(rounds):
        for c, n in zip(cols, gaps, strict=True):
            if n:
                others = [o for o in cols if o != c]
                model = fit_ml(now.where(f"__k_{c}"), "forest_regressor", others, c, numTrees=trees, maxDepth=depth, seed=1)
                guessed = model.transform(assembled(now, others))
                now = stored(guessed.withColumn(c, F.when(F.col(f"__k_{c}"), F.col(c)).otherwise(F.col("prediction"))).drop("features", "prediction"), "filled")
    return now.drop(*(f"__k_{c}" for c in cols))
