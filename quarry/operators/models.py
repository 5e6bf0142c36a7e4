"""Models: closed forms from one pass of sums, and thin layers over pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Linear:
    names: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, sum((F.col(c) * w for c, w in zip(self.names, self.weights, strict=True)), F.lit(self.intercept)))


def fit_linear(df: DataFrame, columns: Sequence[str], target: str, ridge: float = 0.0) -> Linear:
    """Least squares, with a penalty on the weights if asked: sums of products come from one pass, the system is as small as the columns are few."""
    import numpy as np

    from quarry.operators.statistics import factor_covariance

    rows = df.select(*columns, target).dropna()
    means, cov = factor_covariance(rows, [*columns, target])
    n = rows.count()
    k = len(columns)
    a = cov[:k, :k] * (n - 1) + ridge * np.eye(k)
    w = np.linalg.pinv(a) @ (cov[:k, k] * (n - 1))
    return Linear(tuple(columns), tuple(float(x) for x in w), float(means[k] - means[:k] @ w))


def fit_discriminant(df: DataFrame, columns: Sequence[str], label: str, components: int):
    """Directions of the largest between-class over within-class scatter, from one pass by class."""
    import numpy as np

    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = df.groupBy(label).agg(F.count("*"), *(F.avg(c) for c in columns), *(F.covar_pop(columns[i], columns[j]) for i, j in pairs)).collect()
    total = sum(r[1] for r in rows)
    mean = sum(np.array(r[2 : 2 + k], float) * r[1] for r in rows) / total
    within, between = np.zeros((k, k)), np.zeros((k, k))
    for r in rows:
        m = np.array(r[2 : 2 + k], float)
        s = np.zeros((k, k))
        for (i, j), v in zip(pairs, r[2 + k :], strict=True):
            s[i, j] = s[j, i] = v
        within += r[1] * s
        between += r[1] * np.outer(m - mean, m - mean)
    values, vectors = np.linalg.eig(np.linalg.pinv(within) @ between)
    order = np.argsort(-values.real)[:components]
    return values.real[order], vectors.real[:, order]


def principal_components(df: DataFrame, columns: Sequence[str], k: int):
    """(variances, directions) of the largest variance."""
    import numpy as np

    from quarry.operators.statistics import factor_covariance

    _, cov = factor_covariance(df, columns)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return values[order], vectors[:, order]


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)


#: Estimators of pyspark.ml by the names used here.
ESTIMATORS = {
    "logistic": ("classification", "LogisticRegression"), "tree": ("classification", "DecisionTreeClassifier"), "forest": ("classification", "RandomForestClassifier"), "boosted": ("classification", "GBTClassifier"),
    "svm": ("classification", "LinearSVC"), "naive_bayes": ("classification", "NaiveBayes"), "mlp": ("classification", "MultilayerPerceptronClassifier"),
    "tree_regressor": ("regression", "DecisionTreeRegressor"), "forest_regressor": ("regression", "RandomForestRegressor"), "boosted_regressor": ("regression", "GBTRegressor"), "elastic_net": ("regression", "LinearRegression"),
    "glm": ("regression", "GeneralizedLinearRegression"), "isotonic": ("regression", "IsotonicRegression"), "survival": ("regression", "AFTSurvivalRegression"),
    "k_means": ("clustering", "KMeans"), "bisecting": ("clustering", "BisectingKMeans"), "mixture": ("clustering", "GaussianMixture"),
}


def fit_ml(df: DataFrame, kind: str, columns: Sequence[str], target: str | None = None, **params):
    """A fitted model of pyspark.ml; see ESTIMATORS."""
    import importlib

    module, name = ESTIMATORS[kind]
    estimator = getattr(importlib.import_module(f"pyspark.ml.{module}"), name)(featuresCol="features", **({"labelCol": target} if target else {}), **params)
    return estimator.fit(assembled(df, columns))


def reset_test(df: DataFrame, columns: Sequence[str], target: str, powers: int = 3) -> dict[str, float]:
    """Ramsey's test of a linear fit: whether powers 2 to `powers` of its fitted values explain more. Fitted values are scaled, so that powers stay near one."""
    from quarry.functions import special
    from quarry.operators.regressors import least_squares

    rows = df.select(*columns, target).dropna()
    first = least_squares(rows, columns, target)
    m, s = rows.agg(F.avg(first.score()), F.stddev_pop(first.score())).first()
    z = (first.score() - float(m)) / float(s or 1.0)
    more = rows.withColumns({f"__p{p}": F.pow(z, F.lit(float(p))) for p in range(2, powers + 1)})
    second = least_squares(more, [*columns, *(f"__p{p}" for p in range(2, powers + 1))], target)
    small, large = first.variance * (first.n - len(first.names)), second.variance * (second.n - len(second.names))
    q, free = powers - 1, second.n - len(second.names)
    f = max(0.0, (small - large) / q / (large / free)) if large > 0 else 0.0
    return {"n": first.n, "f": f, "p": special.f_sf(f, q, free) if f > 0 else 1.0}


def accumulated_effects(df: DataFrame, column: str, predict, bins: int = 10) -> DataFrame:
    """(bin, edge, n, effect): how a model's prediction changes along a column: in each quantile bin the mean of predict at its upper less its lower edge, summed up and
    centred. predict: a function from a frame to the Column of predictions."""
    from quarry.operators.binning import digitize, quantile_edges

    edges = quantile_edges(df, column, bins)
    if len(edges) < 2:
        edges = edges * 2
    rows = df.where(F.col(column).isNotNull()).withColumn("__b", digitize(F.col(column).cast("double"), edges))
    at = F.array(*map(F.lit, edges))
    low = rows.withColumn(column, F.element_at(at, F.col("__b") + 1))
    low = low.withColumn("__lo", predict(low))
    high = low.withColumn(column, F.element_at(at, F.col("__b") + 2))
    found = high.withColumn("__hi", predict(high)).groupBy("__b").agg(F.count("*").alias("n"), F.avg(F.col("__hi") - F.col("__lo")).alias("d")).collect()  # a row a bin
    by = {r["__b"]: (r["n"], r["d"]) for r in found}
    total, out = 0.0, []
    for b in range(len(edges) - 1):
        n, d = by.get(b, (0, 0.0))
        total += d
        out.append((b, float(edges[b + 1]), n, total))
    whole = sum(n for *_, n, _ in out) or 1
    mean = sum(n * (e - (by.get(b, (0, 0.0))[1]) / 2) for b, _, n, e in out) / whole
    return df.sparkSession.createDataFrame([(b, e, n, v - mean) for b, e, n, v in out], "bin int, edge double, n long, effect double")


def factor_loadings(df: DataFrame, columns: Sequence[str], k: int, rounds: int = 100, rotate: bool = True):
    """(loadings, uniquenesses) by principal axes of the correlation matrix, rotated to simple structure (varimax) if asked."""
    import numpy as np

    from quarry.operators.statistics import factor_covariance

    _, cov = factor_covariance(df, columns)
    sd = np.sqrt(np.diag(cov))
    r = cov / np.outer(sd, sd)
    common = 1 - 1 / np.diag(np.linalg.pinv(r))
    for _ in range(rounds):
        reduced = r.copy()
        np.fill_diagonal(reduced, common)
        values, vectors = np.linalg.eigh(reduced)
        top = np.argsort(-values)[:k]
        loadings = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
        new = np.minimum(1.0, (loadings**2).sum(axis=1))
        done, common = np.abs(new - common).max() < 1e-8, new
        if done:
            break
    if rotate and k > 1:
        turn = np.eye(k)
        for _ in range(rounds):
            b = loadings @ turn
            u, s, v = np.linalg.svd(loadings.T @ (b**3 - b * (b**2).mean(axis=0)))
            new = u @ v
            done, turn = np.abs(new - turn).max() < 1e-10, new
            if done:
                break
        loadings = loadings @ turn
    return loadings, 1 - common


def kernel_components(df: DataFrame, id_col: str, columns: Sequence[str], k: int, kernel: str = "rbf", gamma: float = 1.0, degree: int = 3, landmarks: int = 200) -> DataFrame:
    """df with pc0, pc1, ...: kernel principal components on landmark rows (those of least hash, a bounded sample that the method is fitted to); every row is mapped, by its
    kernel values against the landmarks. Rows with a null get nulls."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructField, StructType

    from quarry.operators.relational import pseudo_random

    if kernel not in ("rbf", "polynomial"):
        raise ValueError("kernel must be 'rbf' or 'polynomial'")
    some = df.dropna(subset=list(columns)).orderBy(pseudo_random(id_col), id_col).limit(landmarks).select(*(F.col(c).cast("double") for c in columns)).collect()
    base = np.array([tuple(r) for r in some], float).reshape(len(some), len(columns))

    def against(x: np.ndarray) -> np.ndarray:
        if kernel == "polynomial":
            return (gamma * x @ base.T + 1) ** degree
        return np.exp(-gamma * np.maximum(0, (x**2).sum(axis=1)[:, None] + (base**2).sum(axis=1) - 2 * x @ base.T))

    m = against(base)
    rows, whole = m.mean(axis=0), m.mean() if len(m) else 0.0
    values, vectors = np.linalg.eigh(m - rows[:, None] - rows[None, :] + whole) if len(m) else (np.zeros(0), np.zeros((0, 0)))
    top = np.argsort(-values)[:k]
    vectors = vectors[:, top]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1) if len(m) else vectors
    weights = vectors / np.sqrt(np.maximum(values[top], 1e-12))
    names, places = [f"pc{i}" for i in range(len(top))], [df.columns.index(c) for c in columns]
    schema = StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in names)])

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in places])
            lost = np.isnan(x).any(axis=1)
            own = against(np.nan_to_num(x))
            mapped = (own - own.mean(axis=1)[:, None] - rows + whole) @ weights
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(mapped[:, i], pa.float64(), mask=lost) for i in range(len(names)))], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Moments:
    """Count, means and centred products of rows seen so far; parts are added up as they come."""

    n: int
    mean: tuple[float, ...]
    products: tuple[tuple[float, ...], ...]

    @staticmethod
    def of(df: DataFrame, columns: Sequence[str]) -> Moments:
        from quarry.operators.statistics import factor_covariance

        rows = df.select(*columns).dropna()
        n = rows.count()
        means, cov = factor_covariance(rows, columns)
        return Moments(n, tuple(map(float, means)), tuple(tuple(map(float, r)) for r in cov * max(0, n - 1)))

    def __add__(self, other: Moments) -> Moments:
        import numpy as np

        n = self.n + other.n
        a, b = np.array(self.mean), np.array(other.mean)
        gap = b - a
        products = np.array(self.products) + np.array(other.products) + np.outer(gap, gap) * self.n * other.n / max(1, n)
        return Moments(n, tuple(map(float, a + gap * other.n / max(1, n))), tuple(tuple(map(float, r)) for r in products))

    def components(self, k: int):
        """(variances, directions) of the largest variance."""
        import numpy as np

        values, vectors = np.linalg.eigh(np.array(self.products) / max(1, self.n - 1))
        order = np.argsort(-values)[:k]
        return values[order], vectors[:, order]
