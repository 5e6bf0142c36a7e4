"""Exact nearest neighbours by boxes (see `boxes`), and what rests on them: classification, imputation, resampling, local outliers, density clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators._store import stored
from quarry.operators.boxes import best_rows, close_cells
from quarry.operators.records import components


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, columns: Sequence[str], k: int, metric: str = "euclidean", farthest: bool = False) -> DataFrame:
    """(query, id, distance, rank): the k nearest (or farthest) other rows of each query; ties to the smaller id. Rows with nulls take no part; ids are unique.

    Of rows at one point the k + 1 smallest ids can be among the k others of any query, so only these are met, and each point is asked once.
    """
    names = [f"c{i}" for i in range(len(columns))]

    def points(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True))).dropna()

    asked = stored(points(queries), "asked")
    held = stored(points(rows).withColumn("n", F.row_number().over(W.partitionBy(*names).orderBy("id"))).where(F.col("n") <= k + 1).drop("n"), "held")
    near = best_rows(held, stored(asked.select(*names).distinct(), "points"), names, k + 1, metric, farthest)
    each = asked.join(near, names).select(F.col("id").alias("query"), F.posexplode(F.slice(F.filter("near", lambda r: r["id"] != F.col("id")), 1, k)).alias("place", "row"))
    return each.select("query", F.col("row.id").alias("id"), F.abs("row.key").alias("distance"), (F.col("place") + 1).alias("rank"))


def knn_classify(train: DataFrame, queries: DataFrame, id_col: str, columns: Sequence[str], label: str, k: int) -> DataFrame:
    """(query, predicted): the commonest label of the k nearest, ties to the smaller label."""
    near = nearest(train, queries, id_col, columns, k)
    named = near.join(train.select(F.col(id_col).cast("long").alias("id"), label), "id").groupBy("query", label).agg(F.count("*").alias("n"))
    return named.groupBy("query").agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("predicted"))


def knn_impute(df: DataFrame, id_col: str, known: Sequence[str], target: str, k: int) -> DataFrame:
    """A missing target becomes the mean of the k nearest rows that have one, by the known columns."""
    near = nearest(df.where(F.col(target).isNotNull()), df.where(F.col(target).isNull()), id_col, known, k)
    found = near.join(df.select(F.col(id_col).cast("long").alias("id"), F.col(target).alias("__t")), "id").groupBy("query").agg(F.avg("__t").alias("__v"))
    return df.join(found, df[id_col].cast("long") == found["query"], "left").withColumn(target, F.coalesce(F.col(target), F.col("__v"))).drop("query", "__v")


def smote(df: DataFrame, id_col: str, columns: Sequence[str], label: str, minority: object, k: int = 5) -> DataFrame:
    """A made row between each minority row and one of its k nearest of the class, at a place fixed by the ids."""
    few = df.where(F.col(label) == F.lit(minority))
    near = nearest(few, few, id_col, columns, k)
    size = W.partitionBy("query")
    pick = near.withColumn("__n", F.count("*").over(size)).where(F.col("rank") == F.pmod(F.xxhash64("query"), F.col("__n")) + 1)
    a = few.select(F.col(id_col).cast("long").alias("query"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = few.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).alias(f"b_{c}") for c in columns))
    u = F.pmod(F.xxhash64("query", "id"), F.lit(1_000_003)) / 1_000_003
    made = pick.join(a, "query").join(b, "id")
    return made.select(F.col("query").alias("source"), *((F.col(f"a_{c}") + u * (F.col(f"b_{c}") - F.col(f"a_{c}"))).alias(c) for c in columns), F.lit(minority).alias(label))


def edited(df: DataFrame, id_col: str, columns: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """Rows whose label is the commonest of their k nearest."""
    voted = knn_classify(df, df, id_col, columns, label, k)
    return df.join(voted, df[id_col].cast("long") == voted["query"]).where(F.col(label) == F.col("predicted")).drop("query", "predicted")


def tomek_links(df: DataFrame, id_col: str, columns: Sequence[str], label: str) -> DataFrame:
    """(a, b): pairs of different labels that are each other's nearest."""
    near = nearest(df, df, id_col, columns, 1).select(F.col("query").alias("a"), F.col("id").alias("b"))
    back = near.select(F.col("a").alias("b"), F.col("b").alias("a"))
    names = df.select(F.col(id_col).cast("long").alias("i"), F.col(label).alias("l"))
    pairs = near.join(back, ["a", "b"]).where("a < b")
    x, y = names.select(F.col("i").alias("a"), F.col("l").alias("la")), names.select(F.col("i").alias("b"), F.col("l").alias("lb"))
    return pairs.join(x, "a").join(y, "b").where("la <> lb").select("a", "b")


def local_outlier_factor(df: DataFrame, id_col: str, columns: Sequence[str], k: int = 10) -> DataFrame:
    """(id, lof): mean density of the neighbours over a row's own."""
    near = stored(nearest(df, df, id_col, columns, k), "near")
    reach = near.groupBy("query").agg(F.max("distance").alias("far"))
    gap = near.join(reach.select(F.col("query").alias("id"), "far"), "id").withColumn("reach", F.greatest("distance", "far"))
    density = gap.groupBy("query").agg((1 / (F.avg("reach") + 1e-12)).alias("lrd"))
    others = near.join(density.select(F.col("query").alias("id"), F.col("lrd").alias("other")), "id").groupBy("query").agg(F.avg("other").alias("other"))
    return others.join(density, "query").select(F.col("query").alias("id"), (F.col("other") / F.col("lrd")).alias("lof"))


def density_clusters(df: DataFrame, id_col: str, x: str, y: str, eps: float, least: int) -> DataFrame:
    """(id, cluster) of two columns: rows of `least` neighbours within eps (themselves too) are core, cores within eps are one cluster (named by its
    smallest id), others join the smallest cluster in reach; the rest have -1.

    Rows at one point are one, and no pair is kept: a point is asked for its `least` nearest rows, and cores meet by cells in which all are within eps.
    """
    names, within = ["x", "y"], eps * eps
    p = stored(df.select(F.col(id_col).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(), "rows")
    w = W.partitionBy(*names)
    held = stored(p.withColumn("n", F.row_number().over(w.orderBy("id"))).where(F.col("n") <= least).select(F.min("id").over(w).alias("id"), *names), "held")
    points = stored(held.distinct(), "points")
    asked = stored(best_rows(held, points.select(*names), names, least, "squared", within=within).join(points, names), "near")
    core = stored(asked.where(F.size("near") >= least).select("id", *names), "core")
    links, s = close_cells(core, eps)
    cells = core.withColumns({"i": F.floor(F.col("x") / s), "j": F.floor(F.col("y") / s)})
    first = stored(cells.groupBy("i", "j").agg(F.min("id").alias("first")), "cells")
    ends = links
    for side in "ab":
        ends = ends.join(first.select(F.col("i").alias(f"{side}i"), F.col("j").alias(f"{side}j"), F.col("first").alias(side)), [f"{side}i", f"{side}j"])
    named = first.join(components(ends.where("a <> b").select("a", "b")), F.col("first") == F.col("node"), "left").select("i", "j", F.coalesce("component", "first").alias("cluster"))
    label = stored(cells.join(named, ["i", "j"]).select("id", *names, "cluster"), "labels")
    edge = asked.where(F.size("near") < least).select(*names, F.explode("near.id").alias("id")).join(label.select("id", "cluster"), "id").groupBy(*names).agg(F.min("cluster").alias("cluster"))
    return p.join(label.select(*names, "cluster").unionByName(edge), names, "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def k_medians(df: DataFrame, columns: Sequence[str], k: int, rounds: int = 10) -> list[list[float]]:
    """Centres of least absolute distance: assignment is an expression, the medians one aggregate a round."""
    row = df.agg(*(F.percentile(c, F.array(*(F.lit((i + 0.5) / k) for i in range(k)))).alias(c) for c in columns)).first()
    centres = [[row[c][i] for c in columns] for i in range(k)]
    for _ in range(rounds):
        far = [sum((F.abs(F.col(c) - v) for c, v in zip(columns, ctr, strict=True)), F.lit(0.0)) for ctr in centres]
        best = F.least(*far) if k > 1 else far[0]
        which = F.coalesce(*(F.when(d == best, i) for i, d in enumerate(far)))
        found = {r["g"]: [r[c] for c in columns] for r in df.groupBy(which.alias("g")).agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in columns)).collect() if r["g"] is not None}
        new = [found.get(i, ctr) for i, ctr in enumerate(centres)]
        if new == centres:
            break
        centres = new
    return centres
