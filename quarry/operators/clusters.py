"""Clusters around centres, trees of clusters, and clusters of graphs.

A round of a centre method is one aggregate over all rows; what the driver holds are the centres. Trees of clusters are built over
distinct points or grid cells, of which there is a stated most.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.relational import MODULUS, pseudo_random

Points = list[list[float]]


def squared_distance(columns: Sequence[str], point: Sequence[float]) -> Column:
    return sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(columns, point, strict=True)), F.lit(0.0))


def nearest_place(distances: Sequence[Column]) -> Column:
    """The position of the least distance, the first of equal ones; null where a distance is null."""
    out, best = F.lit(0), distances[0]
    for i, d in enumerate(distances[1:], start=1):
        out, best = F.when(d < best, i).otherwise(out), F.least(best, d)
    return F.when(best.isNotNull(), out)


@dataclass(frozen=True)
class Centres:
    columns: tuple[str, ...]
    points: tuple[tuple[float, ...], ...]

    def distances(self) -> list[Column]:
        return [squared_distance(self.columns, p) for p in self.points]

    def predict(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        return df.withColumn(name, nearest_place(self.distances()))

    def inertia(self, df: DataFrame) -> float:
        """The sum of squared distances to the nearest centre."""
        d = self.distances()
        return df.agg(F.sum(F.least(*d) if len(d) > 1 else d[0])).first()[0] or 0.0


def initial_centres(df: DataFrame, id_col: str, columns: Sequence[str], k: int, how: str = "k-means++", seed: int = 0) -> Centres:
    """`random`: the k rows of least hash; `k-means++`: each next row drawn with odds by its squared distance to the nearest centre so far."""
    rows = df.dropna(subset=list(columns))
    if how == "random":
        found = rows.orderBy(pseudo_random(id_col, seed), id_col).limit(k).select(*columns).collect()
        return Centres(tuple(columns), tuple(tuple(map(float, r)) for r in found))
    if how != "k-means++":
        raise ValueError("how must be 'random' or 'k-means++'")
    points: Points = []
    for i in range(k):
        u = (pseudo_random(id_col, seed + i) + 1) / (MODULUS + 1)
        weight = F.lit(1.0)
        if points:
            d = [squared_distance(columns, p) for p in points]
            weight = F.least(*d) if len(d) > 1 else d[0]
        found = rows.where(weight > 0).agg(F.max_by(F.array(*(F.col(c).cast("double") for c in columns)), F.log(u) / weight)).first()[0]
        if found is None:  # fewer distinct rows than centres
            break
        points.append(list(found))
    return Centres(tuple(columns), tuple(map(tuple, points)))


def k_means(df: DataFrame, centres: Centres, rounds: int = 20, tolerance: float = 1e-4) -> Centres:
    """Lloyd's rounds until no centre moves by more than `tolerance`; a centre without rows stays."""
    for _ in range(rounds):
        named = centres.predict(df, "__c").where("__c IS NOT NULL")
        found = {r["__c"]: r[1:] for r in named.groupBy("__c").agg(*(F.avg(c) for c in centres.columns)).collect()}
        points = tuple(tuple(found.get(i, p)) for i, p in enumerate(centres.points))
        moved = max(math.dist(a, b) for a, b in zip(points, centres.points, strict=True))
        centres = Centres(centres.columns, points)
        if moved <= tolerance:
            break
    return centres


def gap_statistic(df: DataFrame, id_col: str, columns: Sequence[str], ks: Sequence[int], references: int = 5, seed: int = 0) -> list[tuple[int, float, float]]:
    """(k, gap, deviation): how far ln W_k falls below its mean over tables of as many rows, uniform between the columns' ends."""
    lows = df.agg(*(F.min(c).cast("double") for c in columns), *(F.max(c).cast("double") for c in columns)).first()
    ends = list(zip(lows[: len(columns)], lows[len(columns) :], strict=True))

    def log_within(rows: DataFrame, k: int) -> float:
        return math.log(max(1e-300, k_means(rows, initial_centres(rows, id_col, columns, k, seed=seed)).inertia(rows)))

    out = []
    for k in ks:
        flat = []
        for r in range(references):
            made = df.select(id_col, *((pseudo_random(id_col, 1000 + seed + r * len(columns) + j) / MODULUS * (b - a) + a).alias(c) for j, (c, (a, b)) in enumerate(zip(columns, ends, strict=True))))
            flat.append(log_within(made, k))
        out.append((k, float(np.mean(flat)) - log_within(df, k), float(np.std(flat) * math.sqrt(1 + 1 / references))))
    return out


def best_by_gap(gaps: Sequence[tuple[int, float, float]]) -> int:
    """The first k whose gap is at least the next one's less its deviation."""
    return next((k for (k, g, _), (_, after, s) in zip(gaps, gaps[1:], strict=False) if g >= after - s), gaps[-1][0])


def memberships(distances: Sequence[Column], fuzziness: float = 2.0) -> list[Column]:
    """Fuzzy memberships of a row from its squared distances: they add up to one."""
    inverse = [F.pow(F.greatest(d, F.lit(1e-12)), F.lit(-1.0 / (fuzziness - 1))) for d in distances]
    total = sum(inverse, F.lit(0.0))
    return [i / total for i in inverse]


def fuzzy_means(df: DataFrame, centres: Centres, fuzziness: float = 2.0, rounds: int = 20, tolerance: float = 1e-4, typicality: float | None = None) -> Centres:
    """Fuzzy c-means; with `typicality` (its exponent) possibilistic too: weights u ** m + t ** e, where a centre's typicalities add up to one over all rows."""
    for _ in range(rounds):
        d = centres.distances()
        weights = [F.pow(u, F.lit(fuzziness)) for u in memberships(d, fuzziness)]
        if typicality is not None:
            near = [F.pow(F.greatest(x, F.lit(1e-12)), F.lit(-1.0 / (typicality - 1))) for x in d]
            totals = df.agg(*(F.sum(x) for x in near)).first()
            weights = [w + F.pow(x / float(t), F.lit(typicality)) for w, x, t in zip(weights, near, totals, strict=True)]
        row = df.agg(*(F.sum(w * F.col(c)) / F.sum(w) for w in weights for c in centres.columns)).first()
        size = len(centres.columns)
        points = tuple(tuple(row[i * size : (i + 1) * size]) for i in range(len(d)))
        moved = max(math.dist(a, b) for a, b in zip(points, centres.points, strict=True))
        centres = Centres(centres.columns, points)
        if moved <= tolerance:
            break
    return centres


def divisive(df: DataFrame, id_col: str, columns: Sequence[str], k: int, seed: int = 0) -> Centres:
    """From one cluster to k: the one of most inertia is cut in two by k-means, each time."""
    rows = df.dropna(subset=list(columns))
    first = rows.agg(*(F.avg(c) for c in columns)).first()
    points: Points = [list(first)]
    while len(points) < k:
        now = Centres(tuple(columns), tuple(map(tuple, points)))
        d = now.distances()
        named = now.predict(rows, "__c")
        loss = named.groupBy("__c").agg(F.sum(F.least(*d) if len(d) > 1 else d[0]).alias("w")).orderBy(F.desc("w"), "__c").first()
        part = named.where(F.col("__c") == loss["__c"]).drop("__c")
        halves = k_means(part, initial_centres(part, id_col, columns, 2, seed=seed))
        if len(halves.points) < 2:
            break
        points = [p for i, p in enumerate(points) if i != loss["__c"]] + [list(p) for p in halves.points]
    return Centres(tuple(columns), tuple(map(tuple, points)))


def merged_tree(points: np.ndarray, sizes: np.ndarray, k: int, linkage: str = "ward") -> np.ndarray:
    """A label from 0 for each point of given weight: the two nearest clusters are merged until k are left."""
    n = len(points)
    gap = points[:, None, :] - points[None, :, :]
    d = (gap * gap).sum(axis=2)
    size = sizes.astype(float).copy()
    if linkage == "ward":
        d = d * size[:, None] * size[None, :] / (size[:, None] + size[None, :])
    elif linkage in ("single", "complete", "average"):
        d = np.sqrt(d)
    else:
        raise ValueError("linkage must be 'ward', 'single', 'complete' or 'average'")
    np.fill_diagonal(d, np.inf)
    label, alive = np.arange(n), np.ones(n, bool)
    best = d.argmin(axis=1) if n > 1 else np.zeros(n, int)
    low = d[np.arange(n), best] if n > 1 else np.full(n, np.inf)
    for _ in range(n - k):
        i = int(np.where(alive, low, np.inf).argmin())
        j = int(best[i])
        i, j = min(i, j), max(i, j)
        si, sj = size[i], size[j]
        if linkage == "ward":
            row = ((si + size) * d[i] + (sj + size) * d[j] - size * d[i, j]) / (si + sj + size)
        elif linkage == "single":
            row = np.minimum(d[i], d[j])
        elif linkage == "complete":
            row = np.maximum(d[i], d[j])
        else:
            row = (si * d[i] + sj * d[j]) / (si + sj)
        alive[j] = False
        row[~alive] = np.inf
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] = si + sj
        label[label == j] = i
        for x in np.flatnonzero(alive & ((best == i) | (best == j) | (row < low))):
            best[x] = int(d[x].argmin())
            low[x] = d[x, best[x]]
        best[i] = int(d[i].argmin())
        low[i] = d[i, best[i]]
    return np.unique(label, return_inverse=True)[1]


def _labelled(df: DataFrame, key: Sequence[Column], names: Sequence[str], cells: Sequence, labels: np.ndarray, kinds: str, name: str) -> DataFrame:
    table = df.sparkSession.createDataFrame([(*c, int(v)) for c, v in zip(cells, labels, strict=True)], f"{kinds}, {name} int")
    keyed = df.withColumns({n: c for n, c in zip(names, key, strict=True)})
    return keyed.join(F.broadcast(table), list(names), "left").drop(*names)


def agglomerative(df: DataFrame, columns: Sequence[str], k: int, linkage: str = "ward", most: int = 2000, name: str = "cluster") -> DataFrame:
    """A cluster for each row, by a tree over the distinct points (each of its number of rows' weight). More than `most` are an error: see birch."""
    x = [F.col(c).cast("double") for c in columns]
    names = [f"__{i}" for i in range(len(columns))]
    t = df.dropna(subset=list(columns)).groupBy(*(c.alias(n) for c, n in zip(x, names, strict=True))).agg(F.count("*").alias("n"))
    rows = sorted(tuple(r) for r in t.limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct points")
    points = np.array([r[:-1] for r in rows], float).reshape(len(rows), len(columns))
    labels = merged_tree(points, np.array([r[-1] for r in rows]), min(k, len(rows)), linkage)
    return _labelled(df, x, names, points.tolist(), labels, ", ".join(f"{n} double" for n in names), name)


def birch(df: DataFrame, columns: Sequence[str], k: int, width: float, linkage: str = "ward", most: int = 2000, name: str = "cluster") -> DataFrame:
    """A cluster for each row: rows are summed up in grid cells of a width (count and sums, combined before they move), and a tree is built over the cells' means."""
    cell = [F.floor(F.col(c) / width).cast("long") for c in columns]
    names = [f"__{i}" for i in range(len(columns))]
    t = df.dropna(subset=list(columns)).groupBy(*(c.alias(n) for c, n in zip(cell, names, strict=True))).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)))
    rows = sorted(tuple(r) for r in t.limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"more than {most} cells: take a larger width")
    size = len(columns)
    labels = merged_tree(np.array([r[size + 1 :] for r in rows], float).reshape(len(rows), size), np.array([r[size] for r in rows]), min(k, len(rows)), linkage)
    return _labelled(df, cell, names, [r[:size] for r in rows], labels, ", ".join(f"{n} long" for n in names), name)


def evidence_clusters(df: DataFrame, runs: Sequence[Centres], k: int, name: str = "cluster") -> DataFrame:
    """Clusters of rows that often share a cluster: rows of the same labels in all runs are one class, and classes are merged by average
    linkage on the share of runs in which they differ. There are at most as many classes as combinations of labels."""
    names = [f"__{i}" for i in range(len(runs))]
    labelled = df.withColumns({n: nearest_place(c.distances()) for n, c in zip(names, runs, strict=True)})
    rows = sorted(tuple(r) for r in labelled.dropna(subset=names).groupBy(*names).agg(F.count("*").alias("n")).collect())
    codes = np.array([r[:-1] for r in rows])
    # A run's labels as corners of a simplex: the squared distance of two classes is the share of runs in which they differ.
    corners = np.concatenate([np.eye(codes[:, i].max() + 1)[codes[:, i]] for i in range(len(runs))], axis=1) / math.sqrt(2 * len(runs))
    labels = merged_tree(corners, np.array([r[-1] for r in rows]), min(k, len(rows)), "average")
    table = df.sparkSession.createDataFrame([(*map(int, r[:-1]), int(v)) for r, v in zip(rows, labels, strict=True)], ", ".join(f"{n} int" for n in names) + f", {name} int")
    return labelled.join(table, names, "left").drop(*names)


def markov_clusters(edges: DataFrame, inflation: float = 2.0, rounds: int = 8, least: float = 1e-4) -> DataFrame:
    """(node, cluster) of an undirected graph (src, dst, w): flow is spread by a squared matrix and sharpened by a power, in turns; a node's cluster
    is the smallest node that draws it."""
    from quarry.operators.graph import checkpointed

    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    loops = both.groupBy("src").agg(F.max("w").alias("w")).select("src", F.col("src").alias("dst"), "w")
    flow = both.unionByName(loops).groupBy("src", "dst").agg(F.sum("w").alias("w"))

    def normalised(t: DataFrame) -> DataFrame:
        total = t.groupBy("src").agg(F.sum("w").alias("total"))
        return t.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w"))

    flow = checkpointed(normalised(flow))
    for _ in range(rounds):
        a, b = flow.select("src", F.col("dst").alias("mid"), F.col("w").alias("p")), flow.select(F.col("src").alias("mid"), "dst", F.col("w").alias("q"))
        spread = a.join(b, "mid").groupBy("src", "dst").agg(F.sum(F.col("p") * F.col("q")).alias("w"))
        sharp = normalised(spread.withColumn("w", F.pow("w", F.lit(inflation)))).where(F.col("w") >= least)
        flow = checkpointed(normalised(sharp))
    return flow.where("w > 0.01").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("cluster"))


def _costs(rows: DataFrame, sets: Sequence[Centres], root: bool = False) -> list[float]:
    """The sum of distances to the nearest centre under each of several sets of centres, from one pass."""
    def one(s: Centres) -> Column:
        d = s.distances()
        low = F.least(*d) if len(d) > 1 else d[0]
        return F.sum(F.sqrt(low) if root else low)

    return [float(v or 0.0) for v in rows.agg(*(one(s) for s in sets)).first()]


def medoids(df: DataFrame, id_col: str, columns: Sequence[str], k: int, neighbours: int = 12, rounds: int = 10, seed: int = 0) -> Centres:
    """Medoids by randomised swaps: each round tries `neighbours` sets with one medoid exchanged for a row drawn by its hash, all in one pass over all rows, and takes the
    best while it is better."""
    import random as rnd

    rows = df.dropna(subset=list(columns))
    now, rng = initial_centres(rows, id_col, columns, k, "random", seed), rnd.Random(seed)
    cost = _costs(rows, [now], root=True)[0]
    for i in range(rounds):
        drawn = initial_centres(rows, id_col, columns, neighbours, "random", seed + 1 + i).points
        tries = []
        for p in drawn:
            at = rng.randrange(len(now.points))
            tries.append(Centres(now.columns, (*now.points[:at], p, *now.points[at + 1 :])))
        found = _costs(rows, tries, root=True)
        best = min(range(len(found)), key=lambda j: (found[j], j)) if found else None
        if best is None or found[best] >= cost - 1e-12:
            break
        now, cost = tries[best], found[best]
    return now


def genetic_means(df: DataFrame, id_col: str, columns: Sequence[str], k: int, size: int = 8, generations: int = 6, seed: int = 0) -> Centres:
    """A population of sets of centres: the better half has offspring that take each centre from either parent, one Lloyd step improves each child, and all are
    judged in one pass."""
    import random as rnd

    rng, rows = rnd.Random(seed), df.dropna(subset=list(columns))
    people = [initial_centres(rows, id_col, columns, k, "random", seed + i) for i in range(size)]
    fitness = _costs(rows, people)
    for _ in range(generations):
        order = sorted(range(len(people)), key=lambda i: (fitness[i], i))[: size // 2]
        children = []
        for _ in range(size - len(order)):
            a, b = (people[rng.choice(order)] for _ in range(2))
            mixed = tuple(rng.choice((p, q)) for p, q in zip(sorted(a.points), sorted(b.points), strict=True))
            children.append(k_means(rows, Centres(tuple(columns), mixed), rounds=1))
        people = [people[i] for i in order] + children
        fitness = [fitness[i] for i in order] + _costs(rows, children)
    return people[min(range(len(people)), key=lambda i: (fitness[i], i))]


def consensus(df: DataFrame, runs: Sequence[Centres]) -> DataFrame:
    """(a, b, n_a, n_b, share): classes of rows of the same labels in all runs, and the share of runs that put two of them together; rows' own pairs follow from it."""
    names = [f"__{i}" for i in range(len(runs))]
    t = df.withColumns({n: nearest_place(c.distances()) for n, c in zip(names, runs, strict=True)}).dropna(subset=names).groupBy(F.array(*names).alias("labels")).agg(F.count("*").alias("n"))
    a, b = t.select(F.col("labels").alias("a"), F.col("n").alias("n_a")), t.select(F.col("labels").alias("b"), F.col("n").alias("n_b"))
    same = F.aggregate(F.zip_with("a", "b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return a.crossJoin(F.broadcast(b)).select("a", "b", "n_a", "n_b", (same / len(runs)).alias("share"))


def quick_shift(df: DataFrame, id_col: str, x: str, y: str, width: float) -> DataFrame:
    """(id, cluster) of two columns: every row moves to the nearest row of higher density (rows within `width`; ties to the smaller id) that lies within `width`, and on;
    a cluster bears the id of the row where the way ends. Rows at one point move to the smallest id there, so points move; ways are halved by jumping."""
    from quarry.operators._store import stored
    from quarry.operators.boxes import next_higher, weights_within

    p = stored(df.select(F.col(id_col).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(), "rows")
    points = stored(p.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("w")), "points")
    dense = stored(points.join(weights_within(points, width * width), ["x", "y"]).select("x", "y", "id", "n"), "dense")
    to = stored(next_higher(dense, width * width), "ways")
    while True:
        new = stored(to.join(to.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")), "ways")
        to = new.select("id", "to")
        if new.where("moved").isEmpty():
            return p.select("id", "x", "y").join(points.select("x", "y", F.col("id").alias("first")), ["x", "y"]).join(to.select(F.col("id").alias("first"), "to"), "first").select("id", F.col("to").alias("cluster"))
