"""Feature selection. Linear selections need one covariance matrix, taken in one pass; tree ones fit models of pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.models import fit_ml
from quarry.operators.relational import dense_number, pseudo_random
from quarry.operators.statistics import factor_covariance


def _r2(cov: np.ndarray, chosen: Sequence[int], target: int) -> float:
    if not chosen:
        return 0.0
    a, b = cov[np.ix_(chosen, chosen)], cov[chosen, target]
    return float(b @ np.linalg.pinv(a) @ b / cov[target, target]) if cov[target, target] else 0.0


def forward(df: DataFrame, columns: Sequence[str], target: str, k: int) -> list[tuple[str, float]]:
    """(column, R squared so far): each step adds the column that explains most."""
    _, cov = factor_covariance(df, [*columns, target])
    chosen: list[int] = []
    out = []
    while len(chosen) < min(k, len(columns)):
        best = max((i for i in range(len(columns)) if i not in chosen), key=lambda i: (_r2(cov, [*chosen, i], len(columns)), -i))
        chosen.append(best)
        out.append((columns[best], _r2(cov, chosen, len(columns))))
    return out


def backward(df: DataFrame, columns: Sequence[str], target: str, k: int) -> list[str]:
    """Recursive elimination: each step drops the column whose loss costs least."""
    _, cov = factor_covariance(df, [*columns, target])
    left = list(range(len(columns)))
    while len(left) > k:
        left.remove(max(left, key=lambda i: (_r2(cov, [j for j in left if j != i], len(columns)), i)))
    return [columns[i] for i in left]


def shapley(df: DataFrame, columns: Sequence[str], target: str, orders: int = 200, seed: int = 0) -> list[tuple[str, float]]:
    """Mean gain in R squared over random orders of joining."""
    _, cov = factor_covariance(df, [*columns, target])
    rng, total = np.random.default_rng(seed), np.zeros(len(columns))
    for _ in range(orders):
        seen: list[int] = []
        before = 0.0
        for i in rng.permutation(len(columns)):
            seen.append(int(i))
            now = _r2(cov, seen, len(columns))
            total[i] += now - before
            before = now
    return [(c, float(v)) for c, v in zip(columns, total / orders, strict=True)]


def tree_importances(df: DataFrame, columns: Sequence[str], target: str, classify: bool = True, **params) -> list[tuple[str, float]]:
    model = fit_ml(df, "forest" if classify else "forest_regressor", columns, target, **({"numTrees": 10, "seed": 1} | params))
    return list(zip(columns, map(float, model.featureImportances.toArray()), strict=True))


def sparse(df: DataFrame, columns: Sequence[str], target: str, penalty: float, share: float = 1.0) -> list[str]:
    """Columns with a weight under an elastic net."""
    model = fit_ml(df, "elastic_net", columns, target, regParam=penalty, elasticNetParam=share)
    return [c for c, w in zip(columns, model.coefficients.toArray(), strict=True) if abs(w) > 1e-9]


def stable(df: DataFrame, id_col: str, columns: Sequence[str], target: str, k: int, rounds: int = 10, share: float = 0.5) -> list[tuple[str, float]]:
    """How often each column is among the k forward-chosen ones, over subsamples by the hash of the id."""
    hits = dict.fromkeys(columns, 0)
    for seed in range(rounds):
        part = df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1000)) < share * 1000)
        for c, _ in forward(part, columns, target, k):
            hits[c] += 1
    return [(c, n / rounds) for c, n in hits.items()]


def with_shuffled(df: DataFrame, id_col: str, column: str, seed: int = 0) -> DataFrame:
    """The column's values dealt to other rows, in a random order."""
    rows = dense_number(df, [id_col], "__a")
    values = dense_number(df.select(id_col, F.col(column).alias("__v")).withColumn("__h", pseudo_random(id_col, seed)), ["__h", id_col], "__a").select("__a", "__v")
    return rows.join(values, "__a").withColumn(column, F.col("__v")).drop("__a", "__v")


def permutation_importances(df: DataFrame, id_col: str, columns: Sequence[str], predict, score) -> list[tuple[str, float]]:
    """How much score(predict(df)) falls when a column is shuffled."""
    base = score(predict(df))
    return [(c, base - score(predict(with_shuffled(df, id_col, c)))) for c in columns]


def _joint_counts(df: DataFrame, columns: Sequence[str], label: str) -> dict[tuple[int, int], list[tuple]]:
    """Of every two columns (i <= j) the counts of (value, value, label): one pass, each row giving a cell for each pair."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("p"), text(columns[i]).alias("a"), text(columns[j]).alias("b")) for n, (i, j) in enumerate(pairs)))).alias("c")
    rows = df.select(cells, text(label).alias("l")).groupBy("c.p", "c.a", "c.b", "l").agg(F.count("*").alias("n")).collect()
    out: dict[tuple[int, int], list[tuple]] = {}
    for r in rows:
        out.setdefault(pairs[r["p"]], []).append((r["a"], r["b"], r["l"], r["n"]))
    return out


def _information(cells: Sequence[tuple[object, object, int]]) -> float:
    """Mutual information, in bits, of counts (a, b, n)."""
    total, by_a, by_b, both = 0, {}, {}, {}
    for a, b, n in cells:
        total += n
        by_a[a], by_b[b], both[a, b] = by_a.get(a, 0) + n, by_b.get(b, 0) + n, both.get((a, b), 0) + n
    return sum(n / total * np.log2(n * total / (by_a[a] * by_b[b])) for (a, b), n in both.items()) if total else 0.0


def mutual_information(df: DataFrame, columns: Sequence[str], label: str) -> list[tuple[str, float]]:
    """Bits that each column of few values tells about the label; continuous columns are binned first."""
    counts = _joint_counts(df, columns, label)
    return [(c, float(_information([(a, y, n) for a, _, y, n in counts.get((i, i), [])]))) for i, c in enumerate(columns)]


def by_information(df: DataFrame, columns: Sequence[str], label: str, k: int, how: str = "cmim") -> list[str]:
    """Greedy choice of k columns of few values: `cmim` takes the one whose least information about the label, given any chosen one, is largest; `icap` the one whose
    information, less what it shares with the chosen ones beyond the label, is largest."""
    if how not in ("cmim", "icap"):
        raise ValueError("how must be 'cmim' or 'icap'")
    counts = _joint_counts(df, columns, label)
    own = [_information([(a, y, n) for a, _, y, n in counts.get((i, i), [])]) for i in range(len(columns))]

    def cells(i: int, j: int) -> list[tuple]:
        return counts[i, j] if i <= j else [(b, a, y, n) for a, b, y, n in counts[j, i]]

    def given(rows: list[tuple], at: int, x: int, z: int) -> float:
        """Information of parts x and z of the cells, given part `at`."""
        total, out = sum(r[3] for r in rows), 0.0
        for v in {r[at] for r in rows}:
            part = [(r[x], r[z], r[3]) for r in rows if r[at] == v]
            out += sum(n for *_, n in part) / total * _information(part)
        return out

    chosen: list[int] = []
    while len(chosen) < min(k, len(columns)):
        def worth(i: int) -> float:
            if how == "cmim":
                return min((given(cells(i, j), 1, 0, 2) for j in chosen), default=own[i])
            return own[i] - sum(max(0.0, _information([(a, b, n) for a, b, _, n in cells(i, j)]) - given(cells(i, j), 2, 0, 1)) for j in chosen)

        chosen.append(max((i for i in range(len(columns)) if i not in chosen), key=lambda i: (round(worth(i), 12), -i)))
    return [columns[i] for i in chosen]


def eliminated_cv(df: DataFrame, id_col: str, columns: Sequence[str], target: str, folds: int = 5) -> tuple[list[str], list[tuple[int, float]]]:
    """Recursive elimination with the number of columns chosen by the mean R squared on rows held out; sums of products by fold, from one pass, serve every fit."""
    k, names = len(columns), ["__1", *columns, target]
    rows = df.select(F.lit(1.0).alias("__1"), *(F.col(c).cast("double").alias(c) for c in (*columns, target)), (pseudo_random(id_col, 3) % folds).alias("__f")).dropna()
    pairs = [(i, j) for i in range(k + 2) for j in range(i, k + 2)]
    sums = np.zeros((folds, k + 2, k + 2))
    for r in rows.groupBy("__f").agg(*(F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs)).collect():
        for (i, j), v in zip(pairs, r[1:], strict=True):
            sums[r["__f"], i, j] = sums[r["__f"], j, i] = v
    whole = sums.sum(axis=0)

    def held_out(chosen: list[int]) -> float:
        at, out = [0, *chosen], []
        for f in range(folds):
            train, test = whole - sums[f], sums[f]
            if test[0, 0] == 0:
                continue
            w = np.linalg.pinv(train[np.ix_(at, at)]) @ train[at, k + 1]
            rss = test[k + 1, k + 1] - 2 * w @ test[at, k + 1] + w @ test[np.ix_(at, at)] @ w
            out.append(1 - rss / max(1e-300, test[k + 1, k + 1] - test[0, k + 1] ** 2 / test[0, 0]))
        return float(np.mean(out)) if out else 0.0

    def loss(chosen: list[int]) -> float:
        at = [0, *chosen]
        b = whole[at, k + 1]
        return float(whole[k + 1, k + 1] - b @ np.linalg.pinv(whole[np.ix_(at, at)]) @ b)

    left, history, best = list(range(1, k + 1)), [], None
    while left:
        score = held_out(left)
        history.append((len(left), score))
        if best is None or score >= best[0] - 1e-12:
            best = (score, list(left))
        left.remove(min(left, key=lambda i: (loss([j for j in left if j != i]), -i)))
    return [columns[i - 1] for i in sorted(best[1])] if best else [], history


def automatic(df: DataFrame, columns: Sequence[str], label: str, k: int, least_variance: float = 1e-12, most_inflation: float = 10.0) -> list[str]:
    """The k columns of largest F among those that vary and are not linear in the others."""
    from quarry.operators.features import anova_f, variances, without_collinear

    varied = [r["name"] for r in variances(df, columns).collect() if (r["variance"] or 0) > least_variance]
    kept = without_collinear(df, varied, most_inflation) if len(varied) > 1 else varied
    f = {r["name"]: r["f"] or 0.0 for r in anova_f(df, kept, label).collect()} if kept else {}
    return sorted(kept, key=lambda c: (-f[c], c))[:k]
