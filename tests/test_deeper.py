"""Selection by information, imputation by models, medoids, kernels, factors and bandits against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_learned import blobs, same_partition

from quarry.operators import clusters, control, drift, imputers, kernels, matrices, models, optimizers, selection


def information(pairs):
    n, a, b = Counter(pairs), Counter(x for x, _ in pairs), Counter(y for _, y in pairs)
    t = len(pairs)
    return sum(c / t * math.log2(c * t / (a[x] * b[y])) for (x, y), c in n.items())


def test_choice_by_information(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(600):
        a, b = rng.randint(0, 1), rng.randint(0, 1)
        rows.append((a, a if rng.random() < 0.98 else 1 - a, b, rng.randint(0, 3), 2 * a + b))
    df = spark.createDataFrame(rows, "a int, copy int, b int, noise int, y int")
    columns = ["a", "copy", "b", "noise"]
    got = dict(selection.mutual_information(df, columns, "y"))
    for i, c in enumerate(columns):
        assert got[c] == pytest.approx(information([(r[i], r[4]) for r in rows]))
    for how in ("cmim", "icap"):
        assert set(selection.by_information(df, columns, "y", 2, how)) == {"a", "b"}


def test_elimination_keeps_what_predicts(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 4))
    y = 2 * x[:, 0] - x[:, 2] + 0.1 * rng.standard_normal(400)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, y double")
    kept, history = selection.eliminated_cv(df, "id", ["a", "b", "c", "d"], "y")
    assert {"a", "c"} <= set(kept) and [n for n, _ in history] == [4, 3, 2, 1] and history[2][1] > 0.95 > history[3][1]
    assert selection.automatic(df.withColumn("e", F.lit(1.0)).withColumn("g", (F.col("a") > 0).cast("int")), ["a", "b", "e"], "g", 1) == ["a"]


def test_imputations_differ_as_gaps_leave_open(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(500)
    y = 3 * x + rng.standard_normal(500)
    rows = [(i, float(a), None if i % 3 == 0 else float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    tables = imputers.multiple(df, "id", ["x", "y"], 4)
    means = [t.agg(F.avg("y")).first()[0] for t in tables]
    assert len(set(means)) == 4 and max(abs(m - y.mean()) for m in means) < 0.3
    rest = [r["e"] for r in tables[0].where("id % 3 = 0").select((F.col("y") - 3 * F.col("x")).alias("e")).collect()]
    assert 0.75 < np.std(rest) < 1.25
    assert tables[0].alias("t").join(df.alias("o"), "id").where("o.y IS NOT NULL AND o.y <> t.y").count() == 0
    trees = imputers.by_trees(df, ["x", "y"], rounds=1)
    assert trees.where("y IS NULL").count() == 0 and trees.columns == df.columns
    assert imputers.chains_agree([[1.0, 1.1, 0.9], [1.0, 0.9, 1.1]], [[1.0] * 3] * 2)[1] and not imputers.chains_agree([[1.0, 1.1, 0.9], [9.0, 9.1, 8.9]], [[1.0] * 3] * 2)[1]


def test_other_cluster_methods_find_far_blobs(spark):
    df = blobs(spark)
    for centres in (clusters.medoids(df, "id", ["x", "y"], 3, 20, 12, seed=2), clusters.genetic_means(df, "id", ["x", "y"], 3)):
        assert same_partition(centres.predict(df).collect(), "g", "cluster")
    shifted = clusters.quick_shift(df, "id", "x", "y", 3.0).join(df, "id").collect()
    assert same_partition(shifted, "g", "cluster")
    runs = [clusters.k_means(df, clusters.initial_centres(df, "id", ["x", "y"], 3, seed=s)) for s in (1, 2)]
    pairs = clusters.consensus(df, runs).collect()
    assert all(r["share"] == (1.0 if r["a"] == r["b"] else 0.0) for r in pairs) and sum(r["n_a"] for r in pairs if r["a"] == r["b"]) == 240


def test_models_on_known_shapes(spark):
    df = blobs(spark)
    mapped = models.kernel_components(df, "id", ["x", "y"], 2, gamma=0.05, landmarks=90).collect()
    by = {g: np.mean([[r["pc0"], r["pc1"]] for r in mapped if r["g"] == g], axis=0) for g in range(3)}
    assert min(np.linalg.norm(by[a] - by[b]) for a, b in ((0, 1), (0, 2), (1, 2))) > 0.5
    assert models.kernel_components(df, "id", ["x", "y"], 2, "polynomial", 0.01).count() == 240
    curved = df.withColumn("y", F.col("x") * F.col("x") + F.col("y") * 0.01)
    assert models.reset_test(curved, ["x"], "y")["p"] < 0.01 < models.reset_test(df.withColumn("y", F.col("x") * 2 + F.col("g") * 0.001), ["x"], "y")["p"] + 0.01
    effects = models.accumulated_effects(df, "x", lambda d: 3 * F.col("x") + F.col("y"), 6).orderBy("bin").collect()
    slopes = [(b["effect"] - a["effect"]) / (b["edge"] - a["edge"]) for a, b in zip(effects, effects[1:], strict=False)]
    assert slopes == pytest.approx([3.0] * len(slopes))
    parts = [models.Moments.of(df.where(F.col("id") % 3 == i), ["x", "y"]) for i in range(3)]
    whole = models.Moments.of(df, ["x", "y"])
    merged = parts[0] + parts[1] + parts[2]
    assert merged.n == whole.n and np.allclose(merged.products, whole.products) and np.allclose(merged.components(1)[0], whole.components(1)[0])


def test_factors_of_a_simple_structure(spark):
    rng = np.random.default_rng(6)
    f = rng.standard_normal((2000, 2))
    x = np.column_stack([f[:, 0], f[:, 0], f[:, 0], f[:, 1], f[:, 1], f[:, 1]]) * 0.9 + 0.4 * rng.standard_normal((2000, 6))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(6)))
    loadings, unique = models.factor_loadings(df, [f"c{i}" for i in range(6)], 2)
    big = np.abs(loadings) > 0.7
    assert (big.sum(axis=1) == 1).all() and (big[:3] == big[0]).all() and (big[3:] == big[3]).all() and (unique < 0.3).all()


def test_eigenvalues_by_joins(spark):
    rng = np.random.default_rng(7)
    a = rng.standard_normal((6, 6))
    a = a @ a.T
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(6)], "i int, j int, v double")
    found = matrices.top_eigen(cells, 1, 40, 1e-7)
    assert found[0][0] == pytest.approx(np.linalg.eigvalsh(a)[-1], rel=1e-4)


def test_optimisers_bandits_and_kernels(spark):
    rosen = lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2
    assert optimizers.lbfgs(rosen, [-1.0, 1.0], rounds=500) == pytest.approx([1, 1], abs=1e-2)
    bowl = lambda p: np.array([2 * (p[0] - 1), 8 * (p[1] + 2)])
    for rule, rate in (("sgd", 0.05), ("adagrad", 0.5), ("rmsprop", 0.01), ("adam", 0.05)):
        assert optimizers.descend(bowl, [0.0, 0.0], rule, rate, 4000) == pytest.approx([1, -2], abs=0.05), rule
    arm = control.LinearThompson(2, 2, noise=0.1, seed=1)
    rng = random.Random(1)
    for _ in range(200):
        x = [1.0, rng.choice((-1.0, 1.0))]
        a = arm.choose(x)
        arm.update(a, x, (x[1] if a else -x[1]) + rng.gauss(0, 0.1))
    assert arm.choose([1.0, 1.0]) == 1 and arm.choose([1.0, -1.0]) == 0
    other = control.LinearThompson(2, 2, noise=0.1, seed=1)
    other.update_from(spark.createDataFrame([(1, 1.0, 1.0, 1.0), (0, 1.0, 1.0, -1.0), (1, 1.0, -1.0, -1.0), (0, 1.0, -1.0, 1.0)] * 30, "arm int, a double, b double, r double"), "arm", ["a", "b"], "r")
    assert other.choose([1.0, 1.0]) == 1 and other.choose([1.0, -1.0]) == 0
    x = np.sin(np.arange(50) / 5)
    warped = kernels.time_warped(seed=3)(x)
    assert len(warped) == 50 and warped[0] == pytest.approx(x[0]) and warped[-1] == pytest.approx(x[-1]) and not np.allclose(warped, x)
    assert len(kernels.jittered()(x)) == 50


def test_made_rows_are_held_against_real_ones(spark):
    df = blobs(spark)
    same = {r["name"]: r for r in drift.synthetic_quality(df, df, ["x", "y"]).collect()}
    moved = {r["name"]: r for r in drift.synthetic_quality(df, df.withColumn("x", F.col("x") + 20), ["x", "y"]).collect()}
    assert same["x"]["ks"] == 0 and moved["x"]["ks"] == 1 and moved["y"]["ks"] == 0 and moved["x"]["mean_gap"] > 3
    scores = control.robustness(df, "id", ["x"], lambda d: d.agg(F.corr("x", "y")).first()[0])
    assert [s for s, _ in scores] == [0.0, 0.01, 0.05, 0.1]
