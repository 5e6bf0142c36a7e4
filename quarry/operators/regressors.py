"""Regressors and classifiers fitted by aggregates: what the driver holds are sums of products, and small models.

Rows with a null in any column used take no part. Coefficients come with standard errors where the law gives them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import special
from quarry.operators.relational import MODULUS, pseudo_random


def unit(id_col: str, seed: int | Column = 0) -> Column:
    return pseudo_random(id_col, seed) / MODULUS


def poisson(u: Column, rate: float, most: int = 60) -> Column:
    """The Poisson number that a uniform number u stands for: how many cumulative probabilities it reaches."""
    out, p, total = F.lit(0), math.exp(-rate), math.exp(-rate)
    for i in range(1, most):
        out = out + F.when(u >= total, 1).otherwise(0)
        p *= rate / i
        total += p
        if 1 - total < 1e-12:
            break
    return out


def products(df: DataFrame, terms: Sequence[Column], weight: Column | None = None) -> tuple[np.ndarray, int]:
    """The matrix of sums of products of every two terms over the rows without nulls, from one pass; and how many rows there are."""
    k = len(terms)
    named = df.select(*(t.cast("double").alias(f"t{i}") for i, t in enumerate(terms)), *([weight.cast("double").alias("w")] if weight is not None else [])).dropna()
    w = F.col("w") if weight is not None else F.lit(1.0)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = named.agg(F.count("*"), *(F.sum(w * F.col(f"t{i}") * F.col(f"t{j}")) for i, j in pairs)).first()
    out = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[1:], strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return out, row[0]


@dataclass(frozen=True)
class Fit:
    """names start with "" for the intercept, where there is one."""

    names: tuple[str, ...]
    weights: tuple[float, ...]
    errors: tuple[float, ...]
    n: int
    r2: float = float("nan")
    variance: float = float("nan")

    def score(self) -> Column:
        return sum((F.lit(w) if c == "" else F.col(c) * w for c, w in zip(self.names, self.weights, strict=True)), F.lit(0.0))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.score())

    def table(self, df: DataFrame) -> DataFrame:
        """(name, weight, error, t, p) of each coefficient."""
        free = self.n - len(self.names)
        rows = [(c or "(intercept)", w, e, w / e if e else float("nan"), special.t_sf2(w / e, free) if e and free > 0 else float("nan")) for c, w, e in zip(self.names, self.weights, self.errors, strict=True)]
        return df.sparkSession.createDataFrame(rows, "name string, weight double, error double, t double, p double")


def least_squares(df: DataFrame, columns: Sequence[str], target: str, intercept: bool = True, ridge: float = 0.0, weight: Column | None = None) -> Fit:
    """Ordinary or ridge regression (the intercept is not penalised), with standard errors of the coefficients."""
    names = (["" ] if intercept else []) + list(columns)
    m, n = products(df, [F.lit(1.0) if c == "" else F.col(c) for c in names] + [F.col(target)] + ([] if intercept else [F.lit(1.0)]), weight)
    k = len(names)
    a, b, yy = m[:k, :k], m[:k, k], m[k, k]
    inverse = np.linalg.pinv(a + ridge * np.diag([0.0 if c == "" else 1.0 for c in names]))
    w = inverse @ b
    rss = max(0.0, float(yy - 2 * w @ b + w @ a @ w))
    mean = (m[0, k] / m[0, 0] if intercept else m[k, k + 1] / m[k + 1, k + 1]) if n else 0.0
    total = float(yy - (m[0, 0] if intercept else m[k + 1, k + 1]) * mean * mean)
    variance = rss / (n - k) if n > k else float("nan")
    errors = np.sqrt(np.maximum(0.0, np.diag(inverse @ a @ inverse)) * variance)
    return Fit(tuple(names), tuple(map(float, w)), tuple(map(float, errors)), n, 1 - rss / total if total > 0 else float("nan"), variance)


def logistic(df: DataFrame, columns: Sequence[str], target: str, rounds: int = 25, tolerance: float = 1e-10, ridge: float = 0.0) -> Fit:
    """Binomial regression with a logit link: Newton's steps, each from one pass; errors from the information matrix."""
    names = ("", *columns)
    terms = [F.lit(1.0) if c == "" else F.col(c).cast("double") for c in names]
    y, k = F.col(target).cast("double"), len(names)
    rows = df.select(*dict.fromkeys((*columns, target))).dropna()
    w, inverse, n = np.zeros(k), np.eye(k), 0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum((t * float(v) for t, v in zip(terms, w, strict=True)), F.lit(0.0))))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = rows.select(*(t.alias(f"t{i}") for i, t in enumerate(terms)), (y - p).alias("e"), (p * (1 - p)).alias("v")).agg(
            F.count("*"), *(F.sum(F.col("e") * F.col(f"t{i}")) for i in range(k)), *(F.sum(F.col("v") * F.col(f"t{i}") * F.col(f"t{j}")) for i, j in pairs)
        ).first()
        n, slope, info = row[0], np.array(row[1 : k + 1], float), np.zeros((k, k))
        for (i, j), v in zip(pairs, row[k + 1 :], strict=True):
            info[i, j] = info[j, i] = v
        penalty = ridge * np.diag([0.0, *[1.0] * (k - 1)])
        inverse = np.linalg.pinv(info + penalty)
        step = inverse @ (slope - penalty @ w)
        w = w + step
        if np.abs(step).max() < tolerance:
            break
    return Fit(names, tuple(map(float, w)), tuple(map(float, np.sqrt(np.maximum(0.0, np.diag(inverse))))), n)


def normal_fit(df: DataFrame, value: str) -> DataFrame:
    """(n, mean, mean_error, deviation, deviation_error) of the likeliest normal law."""
    t = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    return t.select("n", "mean", (F.col("deviation") / F.sqrt("n")).alias("mean_error"), "deviation", (F.col("deviation") / F.sqrt(2 * F.col("n"))).alias("deviation_error"))


def exponential_fit(df: DataFrame, value: str) -> DataFrame:
    """(n, rate, rate_error, log_likelihood) of the likeliest exponential law of values above zero."""
    t = df.where(F.col(value) > 0).agg(F.count(value).alias("n"), F.avg(value).alias("m"))
    return t.select("n", (1 / F.col("m")).alias("rate"), (1 / F.col("m") / F.sqrt("n")).alias("rate_error"), (-F.col("n") * (F.log("m") + 1)).alias("log_likelihood"))


def ridge_classifier(df: DataFrame, columns: Sequence[str], is_positive: Column, penalty: float = 1.0) -> Fit:
    """Ridge regression on -1 and 1; the class is the sign of the score."""
    return least_squares(df.withColumn("__y", F.when(is_positive, 1.0).otherwise(-1.0)), columns, "__y", ridge=penalty)


@dataclass(frozen=True)
class Choice:
    """Models of one class each; the class of the largest score is predicted, the first of equal ones."""

    models: tuple[tuple[object, Fit], ...]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        best, out = self.models[0][1].score(), F.lit(self.models[0][0])
        for label, model in self.models[1:]:
            out, best = F.when(model.score() > best, F.lit(label)).otherwise(out), F.greatest(best, model.score())
        return df.withColumn(name, out)


def one_vs_rest(df: DataFrame, label: str, fit: Callable[[DataFrame, Column], Fit], most: int = 1000) -> Choice:
    """fit(df, is_positive) for each class against all others."""
    from quarry.operators.encoding import categories

    return Choice(tuple((c, fit(df, F.col(label).cast("string") == c)) for c in categories(df, label, most)))


def binary_relevance(df: DataFrame, labels: Sequence[str], fit: Callable[[DataFrame, Column], Fit]) -> dict[str, Fit]:
    """A model of its own for each 0/1 label column."""
    return {c: fit(df, F.col(c) == 1) for c in labels}


def bagged(df: DataFrame, id_col: str, fit: Callable[[DataFrame, Column], Fit], n: int, seed: int = 0) -> list[Fit]:
    """fit(df, weight) n times; a row's weights are Poisson numbers of mean one, as in a bootstrap of very many rows."""
    return [fit(df, poisson(unit(id_col, seed + i), 1.0)) for i in range(n)]


def mean_score(models: Sequence[Fit]) -> Column:
    return sum((m.score() for m in models), F.lit(0.0)) / len(models)


@dataclass(frozen=True)
class Stump:
    column: str
    cut: float
    low: float
    high: float

    def score(self) -> Column:
        return F.when(F.col(self.column) <= self.cut, F.lit(self.low)).otherwise(F.lit(self.high))


def _cuts(df: DataFrame, columns: Sequence[str], n: int) -> list[tuple[str, float]]:
    """Approximate quantiles of each column, one pass."""
    at = [i / n for i in range(1, n)]
    row = df.agg(*(F.percentile_approx(F.col(c).cast("double"), at, 1000) for c in columns)).first()
    return [(c, v) for c, found in zip(columns, row, strict=True) for v in sorted(set(found or []))]


def boosted_stumps(df: DataFrame, columns: Sequence[str], target: str, rounds: int = 10, rate: float = 0.3, cuts: int = 16) -> list[Stump]:
    """Gradient boosting of squared loss by one-split trees: each round's best cut, of all columns, comes from one pass of sums."""
    rows = df.select(*columns, F.col(target).cast("double").alias("__y")).dropna()
    places = _cuts(rows, columns, cuts)
    n, mean = rows.agg(F.count("*"), F.avg("__y")).first()
    model = [Stump(columns[0], float("inf"), mean or 0.0, mean or 0.0)]
    for _ in range(rounds if n else 0):
        left = rows.withColumn("__e", F.col("__y") - total_score(model))
        row = left.agg(F.sum("__e"), *(x for c, v in places for x in (F.count_if(F.col(c) <= v), F.sum(F.when(F.col(c) <= v, F.col("__e")).otherwise(0.0))))).first()
        best = None
        for (c, v), below, s in zip(places, row[1::2], row[2::2], strict=True):
            if 0 < below < n:
                gain = s * s / below + (row[0] - s) ** 2 / (n - below)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, Stump(c, v, rate * s / below, rate * (row[0] - s) / (n - below)))
        if best is None:
            break
        model.append(best[1])
    return model


def total_score(stumps: Sequence[Stump]) -> Column:
    return sum((s.score() for s in stumps), F.lit(0.0))


def ada_boost(df: DataFrame, columns: Sequence[str], is_positive: Column, rounds: int = 10, cuts: int = 16) -> list[Stump]:
    """Discrete boosting of one-split trees: weights exp(-y f) are an expression of the model so far, so no round writes rows. The class is the sign of total_score."""
    rows = df.withColumn("__y", F.when(is_positive, 1.0).otherwise(-1.0)).select(*columns, "__y").dropna()
    places = _cuts(rows, columns, cuts)
    model: list[Stump] = []
    for _ in range(rounds):
        weighed = rows.withColumn("__w", F.exp(-F.col("__y") * total_score(model)))
        row = weighed.agg(F.sum("__w"), F.sum(F.col("__w") * F.col("__y")), *(F.sum(F.when(F.col(c) <= v, F.col("__w") * F.col("__y")).otherwise(0.0)) for c, v in places)).first()
        if not row[0] or not places:
            break
        # With signs s below the cut and -s above, the share of weight that errs is (1 - s (below - above)) / 2.
        edges = [(2 * below - row[1]) / row[0] for below in row[2:]]
        at = max(range(len(places)), key=lambda i: abs(edges[i]))
        edge = max(-1 + 1e-9, min(1 - 1e-9, edges[at]))
        if abs(edge) < 1e-9:
            break
        vote = 0.5 * math.log((1 + edge) / (1 - edge))
        model.append(Stump(*places[at], vote, -vote))
    return model


def ransac(df: DataFrame, id_col: str, columns: Sequence[str], target: str, threshold: float, trials: int = 20, sample: int = 10, seed: int = 0) -> tuple[Fit, int]:
    """Least squares over the rows within `threshold` of the best of many fits to small samples; and how many these are. One pass counts the inliers of all trials."""
    rows = df.dropna(subset=[*columns, target])
    models = []
    for i in range(trials):
        few = rows.orderBy(pseudo_random(id_col, seed + i), id_col).limit(sample)
        models.append(least_squares(few, columns, target))
    inside = [F.abs(F.col(target) - m.score()) <= threshold for m in models]
    counts = rows.agg(*(F.count_if(i) for i in inside)).first()
    best = max(range(trials), key=lambda i: (counts[i], -i))
    return least_squares(rows.where(inside[best]), columns, target), counts[best]


def online(df: DataFrame, id_col: str, columns: Sequence[str], is_positive: Column, rule: str = "passive_aggressive", epochs: int = 5, shards: int = 16, aggressiveness: float = 1.0) -> Fit:
    """Perceptron or passive-aggressive (PA-I) learning: in each epoch every shard of rows, dealt by the hash of the id and ordered by it, learns in turn from the
    common weights, and the shards' weights are averaged by rows."""
    if rule not in ("perceptron", "passive_aggressive"):
        raise ValueError("rule must be 'perceptron' or 'passive_aggressive'")
    import pandas as pd

    k = len(columns) + 1
    h = pseudo_random(id_col, 17)
    rows = df.select((h % shards).alias("__s"), h.alias("__h"), F.when(is_positive, 1.0).otherwise(-1.0).alias("__y"), *(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    w = np.zeros(k)

    def learn(start: np.ndarray):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("__h")
            x = np.column_stack([np.ones(len(part)), part[list(columns)].to_numpy(float)])
            own = start.copy()
            for row, y in zip(x, part["__y"].to_numpy(), strict=True):
                margin = y * (own @ row)
                if rule == "perceptron":
                    own += y * row if margin <= 0 else 0.0
                elif margin < 1:
                    own += min(aggressiveness, (1 - margin) / (row @ row)) * y * row
            return pd.DataFrame([[float(len(part)), *own]], columns=["n", *(f"w{i}" for i in range(k))])

        return run

    n = 0
    for _ in range(epochs):
        found = rows.groupBy("__s").applyInPandas(learn(w), "n double, " + ", ".join(f"w{i} double" for i in range(k))).collect()  # a row a shard
        n = int(sum(r["n"] for r in found))
        if n:
            w = sum(r["n"] * np.array([r[f"w{i}"] for i in range(k)]) for r in sorted(found)) / n
    return Fit(("", *columns), tuple(map(float, w)), (0.0,) * k, n)


def cox(df: DataFrame, columns: Sequence[str], time: str, event: str, rounds: int = 20, tolerance: float = 1e-9, ridge: float = 0.0) -> Fit:
    """Proportional hazards by Newton's steps on the partial likelihood (ties after Breslow). Sums over those still at risk are sums by time, and running sums
    over the times from the last."""
    from quarry.operators.relational import running_sums

    k = len(columns)
    rows = df.select(F.col(time).cast("double").alias("__t"), F.col(event).cast("double").alias("__d"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).dropna()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w, inverse, n = np.zeros(k), np.eye(k), rows.count()
    for _ in range(rounds):
        risk = F.exp(sum((F.col(f"x{i}") * float(v) for i, v in enumerate(w)), F.lit(0.0)))
        by = rows.groupBy("__t").agg(
            F.sum("__d").alias("d"), F.sum(risk).alias("s"), *(F.sum(risk * F.col(f"x{i}")).alias(f"s{i}") for i in range(k)),
            *(F.sum(risk * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs), *(F.sum(F.col("__d") * F.col(f"x{i}")).alias(f"e{i}") for i in range(k)),
        )
        sums = ["s", *(f"s{i}" for i in range(k)), *(f"s{i}_{j}" for i, j in pairs)]
        later = running_sums(by.withColumn("__back", -F.col("__t")), "__back", {f"r{c}": c for c in sums})
        r = {c: F.col(c) + F.col(f"r{c}") for c in sums}
        row = later.agg(
            *(F.sum(F.col(f"e{i}") - F.col("d") * r[f"s{i}"] / r["s"]) for i in range(k)),
            *(F.sum(F.col("d") * (r[f"s{i}_{j}"] / r["s"] - r[f"s{i}"] * r[f"s{j}"] / (r["s"] * r["s"]))) for i, j in pairs),
        ).first()
        slope, info = np.array(row[:k], float) - ridge * w, np.zeros((k, k))
        for (i, j), v in zip(pairs, row[k:], strict=True):
            info[i, j] = info[j, i] = v
        inverse = np.linalg.pinv(info + ridge * np.eye(k))
        step = inverse @ slope
        w = w + step
        if np.abs(step).max() < tolerance:
            break
    return Fit(tuple(columns), tuple(map(float, w)), tuple(map(float, np.sqrt(np.maximum(0.0, np.diag(inverse))))), n)


def jackknife_mean(df: DataFrame, value: str) -> DataFrame:
    """(n, estimate, error, bias) of the mean, each row left out in turn: sums less the row, so one pass after the total."""
    x = F.col(value).cast("double")
    total = df.agg(F.count(x).alias("n"), F.sum(x).alias("s"))
    each = df.where(x.isNotNull()).crossJoin(F.broadcast(total)).select("n", (F.col("s") / F.col("n")).alias("m"), ((F.col("s") - x) / (F.col("n") - 1)).alias("v"))
    t = each.groupBy("n", "m").agg(F.avg("v").alias("a"), F.var_pop("v").alias("q"))
    return t.select("n", F.col("m").alias("estimate"), F.sqrt((F.col("n") - 1) * F.col("q")).alias("error"), ((F.col("n") - 1) * (F.col("a") - F.col("m"))).alias("bias"))


def bootstrap_means(df: DataFrame, id_col: str, value: str, rounds: int = 50, seed: int = 0) -> DataFrame:
    """(round, mean): means under Poisson weights; every row meets every round's weight in the same pass."""
    x = F.col(value).cast("double")
    each = df.where(x.isNotNull()).select(x.alias("x"), F.col(id_col), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    w = poisson(unit(id_col, F.lit(seed) + F.col("round")), 1.0)
    return each.groupBy("round").agg((F.sum(w * F.col("x")) / F.sum(w)).alias("mean"))


def permutation_test(df: DataFrame, id_col: str, value: str, is_first: Column, rounds: int = 50, seed: int = 0) -> DataFrame:
    """(n, difference, p): of means, against labels dealt anew: in each round the rows of least hash make up the first group, whose size stays."""
    from quarry.operators.relational import dense_number

    rows = df.where(F.col(value).isNotNull()).select(F.col(id_col).alias("__id"), F.col(value).cast("double").alias("x"), is_first.alias("a"))
    n, size, difference = rows.agg(F.count("*"), F.count_if("a"), F.avg(F.when(F.col("a"), F.col("x"))) - F.avg(F.when(~F.col("a"), F.col("x")))).first()
    each = rows.select("__id", "x", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    placed = dense_number(each.withColumn("__h", pseudo_random("__id", F.lit(seed) + F.col("round"))), ["round", "__h", "__id"], "k")
    first = (F.col("k") - F.col("round") * n) < size
    t = placed.groupBy("round").agg((F.avg(F.when(first, F.col("x"))) - F.avg(F.when(~first, F.col("x")))).alias("d"))
    return t.agg(F.lit(n).alias("n"), F.lit(difference).alias("difference"), ((F.count_if(F.abs("d") >= abs(difference)) + 1) / (F.count("*") + 1)).alias("p"))


def holdout_scores(df: DataFrame, id_col: str, label: str, share: float, rounds: int, fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], float], seed: int = 0) -> list[float]:
    """Scores on `rounds` stratified parts held out."""
    from quarry.operators.relational import stratified_split

    out = []
    for i in range(rounds):
        split = stratified_split(df, id_col, label, share, seed + i, name="__test")
        out.append(score(fit(split.where("NOT __test").drop("__test")), split.where("__test").drop("__test")))
    return out


def learning_curve(df: DataFrame, id_col: str, shares: Sequence[float], fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], float], seed: int = 0) -> list[tuple[float, float]]:
    """(share, score on a fixed fifth) of models fitted to growing parts of the rest."""
    u = unit(id_col, seed)
    held = df.where(u >= 0.8)
    return [(s, score(fit(df.where(u < 0.8 * s)), held)) for s in shares]


def pooled(estimates: Sequence[float], variances: Sequence[float]) -> Mapping[str, float]:
    """Rubin's rules for estimates from several imputations: the mean, the total variance, and the share due to what is missing."""
    m, within = len(estimates), float(np.mean(variances))
    between = float(np.var(estimates, ddof=1)) if m > 1 else 0.0
    total = within + (1 + 1 / m) * between
    return {"estimate": float(np.mean(estimates)), "variance": total, "missing": (1 + 1 / m) * between / total if total else 0.0}
