"""Outliers by isolation trees, by density and by the gap at the ends."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.operators.relational import pseudo_random

#: Dixon's critical ratios at 95 %, for 3 to 30 values.
DIXON_95 = (0.970, 0.829, 0.710, 0.625, 0.568, 0.526, 0.493, 0.466, 0.444, 0.426, 0.410, 0.396, 0.384, 0.374, 0.365, 0.356, 0.349, 0.342, 0.337, 0.331, 0.326, 0.321, 0.317, 0.312, 0.308, 0.305, 0.301, 0.290)


def average_path(n: float) -> float:
    """The mean depth of an unsuccessful search in a binary tree of n values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_tree(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows (column or -1, cut, left, right, depth) of a tree of random cuts; a leaf's last number adds the mean depth of what it still holds."""
    most, nodes, todo = math.ceil(math.log2(max(2, len(x)))), [], [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][3 if is_right else 2] = at
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        open_ = np.flatnonzero(high > low)
        if depth >= most or len(rows) <= 1 or not len(open_):
            nodes.append([-1, 0.0, 0, 0, depth + average_path(len(rows))])
            continue
        c = int(rng.choice(open_))
        cut = float(rng.uniform(low[c], high[c]))
        nodes.append([c, cut, 0, 0, 0.0])
        todo += [(rows[x[rows, c] >= cut], depth + 1, at, True), (rows[x[rows, c] < cut], depth + 1, at, False)]
    return np.array(nodes, float)


def path_lengths(trees: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The mean depth of each row over the trees."""
    total = np.zeros(len(x))
    for tree in trees:
        at = np.zeros(len(x), np.int64)
        while True:
            column = tree[at, 0].astype(np.int64)
            inner = np.flatnonzero(column >= 0)
            if not len(inner):
                break
            left = x[inner, column[inner]] < tree[at[inner], 1]
            at[inner] = np.where(left, tree[at[inner], 2], tree[at[inner], 3]).astype(np.int64)
        total += tree[at, 4]
    return total / max(1, len(trees))


def isolation_scores(df: DataFrame, id_col: str, columns: Sequence[str], trees: int = 50, sample: int = 256, seed: int = 0, name: str = "score") -> DataFrame:
    """df's rows with a score near 1 for what few random cuts isolate. The method fits each tree to `sample` rows (those of its own least hashes), so the driver holds
    trees * sample rows whatever the table; every row is scored where it lies. Rows with a null in a column get a null score."""
    rows = df.select(F.col(id_col).alias("__id"), *(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    forest, rng = [], np.random.default_rng(seed)
    per_tree = rows.withColumn("__u", pseudo_random("__id", seed)).orderBy("__u", "__id").limit(trees * sample).drop("__u", "__id").collect()
    whole = np.array([tuple(r) for r in per_tree], float).reshape(len(per_tree), len(columns))
    size = min(sample, len(whole))
    for i in range(trees if size else 0):
        part = whole[i * sample : (i + 1) * sample] if len(whole) == trees * sample else whole[rng.choice(len(whole), size, replace=False)]
        forest.append(isolation_tree(part, rng))
    shared, usual = df.sparkSession.sparkContext.broadcast(forest), average_path(size) or 1.0
    schema, places = StructType([*df.schema.fields, StructField(name, DoubleType())]), [df.columns.index(c) for c in columns]

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in places]) if batch.num_rows else np.zeros((0, len(places)))
            score = np.exp2(-path_lengths(shared.value, np.nan_to_num(x)) / usual)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64(), mask=np.isnan(x).any(axis=1))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def dixon_q(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(by, n, low_q, high_q, low_out, high_out) of groups of 3 to 30 values: the gap at either end over the range, against the critical ratio."""
    w, whole = W.partitionBy(*by).orderBy(column), W.partitionBy(*by)
    x = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("x"), F.row_number().over(w).alias("i"), F.count("*").over(whole).alias("n"))
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("x")))
    t = x.where("n BETWEEN 3 AND 30").groupBy(*by, "n").agg(at(1).alias("a"), at(2).alias("b"), at(F.col("n") - 1).alias("c"), at(F.col("n")).alias("d"))
    spread = F.col("d") - F.col("a")
    critical = F.element_at(F.array(*map(F.lit, DIXON_95)), (F.col("n") - 2).cast("int"))
    q = lambda gap: F.when(spread > 0, gap / spread).otherwise(0.0)
    t = t.select(*by, "n", q(F.col("b") - F.col("a")).alias("low_q"), q(F.col("d") - F.col("c")).alias("high_q"))
    return t.withColumns({"low_out": F.col("low_q") > critical, "high_out": F.col("high_q") > critical})


def density_outliers(df: DataFrame, column: str, share: float = 0.01, bins: int = 256, name: str = "is_outlier") -> DataFrame:
    """Rows where a Gaussian kernel density over a histogram of `bins` is among the lowest `share` of rows."""
    from quarry.operators.binning import digitize, equal_width_edges

    x = F.col(column).cast("double")
    n, sd = df.agg(F.count(x), F.stddev_samp(x)).first()
    edges = equal_width_edges(df, column, bins)
    counts = {r["b"]: r["n"] for r in df.where(x.isNotNull()).groupBy(digitize(x, edges).alias("b")).agg(F.count("*").alias("n")).collect()}  # `bins` rows
    centre = (np.array(edges[1:]) + np.array(edges[:-1])) / 2
    width = 1.06 * (sd or 1.0) * max(n, 1) ** -0.2
    weight = np.array([counts.get(i, 0) for i in range(bins)], float)
    density = (np.exp(-0.5 * ((centre[:, None] - centre[None, :]) / max(width, 1e-300)) ** 2) * weight).sum(axis=1)
    order = np.argsort(density, kind="stable")
    low = order[: int(np.searchsorted(np.cumsum(weight[order]), share * n, side="right"))].tolist()
    return df.withColumn(name, F.when(x.isNotNull(), digitize(x, edges).isin(low) if low else F.lit(False)))
