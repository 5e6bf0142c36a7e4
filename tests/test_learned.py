"""Clusters, regressors, records, resampling, outliers, searches and base shapes against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import base, clusters, features, intervals, kernels, outliers, records, regressors, resampling, seeking
from quarry.operators import text as tx


def blobs(spark, n=240, centres=((0.0, 0.0), (10.0, 0.0), (0.0, 10.0)), seed=1):
    rng = random.Random(seed)
    rows = [(i, *(rng.gauss(c, 0.6) for c in centres[i % len(centres)]), i % len(centres)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, y double, g int").repartition(3)


def same_partition(rows, a, b):
    """Whether two labellings group the rows alike."""
    pairs = {(r[a], r[b]) for r in rows}
    return len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_every_cluster_method_finds_far_blobs(spark):
    df = blobs(spark)
    start = clusters.initial_centres(df, "id", ["x", "y"], 3)
    assert len(start.points) == 3 and start == clusters.initial_centres(df.repartition(5), "id", ["x", "y"], 3)
    fitted = clusters.k_means(df, start)
    found = [fitted.predict(df), clusters.fuzzy_means(df, start).predict(df), clusters.fuzzy_means(df, start, typicality=2.0).predict(df), clusters.divisive(df, "id", ["x", "y"], 3).predict(df), clusters.birch(df, ["x", "y"], 3, 0.5)]
    found += [clusters.agglomerative(df, ["x", "y"], 3, how) for how in ("ward", "single", "complete", "average")]
    runs = [clusters.k_means(df, clusters.initial_centres(df, "id", ["x", "y"], k, seed=k), 10) for k in (3, 4)]
    found.append(clusters.evidence_clusters(df, runs, 3))
    for labelled in found:
        assert same_partition(labelled.collect(), "g", "cluster")
    assert fitted.inertia(df) == pytest.approx(sum(min((r.x - a) ** 2 + (r.y - b) ** 2 for a, b in fitted.points) for r in df.collect()))
    gaps = clusters.gap_statistic(df, "id", ["x", "y"], [2, 3, 4], 2)
    assert clusters.best_by_gap(gaps) == 3
    with pytest.raises(ValueError, match="distinct points"):
        clusters.agglomerative(df, ["x", "y"], 3, most=10)


def plain_tree(points, k, linkage):
    groups = [[i] for i in range(len(points))]

    def gap(a, b):
        d = [math.dist(points[i], points[j]) for i in a for j in b]
        if linkage == "ward":
            ca, cb = np.mean([points[i] for i in a], axis=0), np.mean([points[i] for i in b], axis=0)
            return len(a) * len(b) / (len(a) + len(b)) * float(((ca - cb) ** 2).sum())
        return {"single": min, "complete": max, "average": lambda v: sum(v) / len(v)}[linkage](d)

    while len(groups) > k:
        _, i, j = min((gap(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("linkage", ["ward", "single", "complete", "average"])
def test_merged_trees_equal_a_plain_version(linkage):
    rng = np.random.default_rng(4)
    for n, k in ((2, 1), (12, 3), (25, 5), (25, 1)):
        points = rng.random((n, 2))
        labels = clusters.merged_tree(points, np.ones(n), k, linkage)
        assert {frozenset(np.flatnonzero(labels == v).tolist()) for v in set(labels.tolist())} == plain_tree(points.tolist(), k, linkage)


def test_markov_flow_separates_two_cliques(spark):
    edges = [(a, b, 1.0) for base_ in (0, 10) for a in range(base_, base_ + 5) for b in range(a + 1, base_ + 5)] + [(4, 10, 0.1)]
    got = {r["node"]: r["cluster"] for r in clusters.markov_clusters(spark.createDataFrame(edges, "src long, dst long, w double")).collect()}
    assert len(set(got.values())) == 2 and all(got[i] == got[0] for i in range(5)) and all(got[i] == got[10] for i in range(10, 15))


def test_cox_and_logistic_equal_plain_newton(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 2))
    time = np.round(rng.exponential(np.exp(-(0.8 * x[:, 0] - 0.5 * x[:, 1]))) * 20) + 1
    event = (rng.random(300) < 0.7).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.3 + x[:, 0])))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(t), float(e), float(z)) for (a, b), t, e, z in zip(x, time, event, y, strict=True)] + [(None, 1.0, 2.0, 1.0, 1.0)], "a double, b double, t double, e double, y double")
    w = np.zeros(2)
    for _ in range(30):
        slope, info = np.zeros(2), np.zeros((2, 2))
        for i in np.flatnonzero(event):
            risk = time >= time[i]
            p = np.exp(x[risk] @ w)
            m = (p[:, None] * x[risk]).sum(axis=0) / p.sum()
            slope += x[i] - m
            info += (p[:, None, None] * x[risk][:, :, None] * x[risk][:, None, :]).sum(axis=0) / p.sum() - np.outer(m, m)
        w = w + np.linalg.solve(info, slope)
    got = regressors.cox(df, ["a", "b"], "t", "e")
    assert got.weights == pytest.approx(w, abs=1e-6) and got.errors == pytest.approx(np.sqrt(np.diag(np.linalg.inv(info))), rel=1e-5) and got.n == 300
    design, v = np.column_stack([np.ones(300), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ v))
        information = design.T @ (design * (p * (1 - p))[:, None])
        v = v + np.linalg.solve(information, design.T @ (y - p))
    fit = regressors.logistic(df.dropna(), ["a", "b"], "y")
    assert fit.weights == pytest.approx(v, abs=1e-6) and fit.errors == pytest.approx(np.sqrt(np.diag(np.linalg.inv(information))), rel=1e-5)


def test_least_squares_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 2))
    y = 3 + x @ [1.5, -2.0] + rng.standard_normal(200)
    df = spark.createDataFrame([(float(a), float(b), float(v)) for (a, b), v in zip(x, y, strict=True)], "a double, b double, y double")
    design = np.column_stack([np.ones(200), x])
    beta, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
    fit = regressors.least_squares(df, ["a", "b"], "y")
    assert fit.weights == pytest.approx(beta) and fit.errors == pytest.approx(np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 197)) and fit.r2 == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum())
    flat = regressors.least_squares(df, ["a", "b"], "y", intercept=False)
    assert flat.weights == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0])
    penalised = regressors.least_squares(df, ["a", "b"], "y", ridge=7.0)
    assert penalised.weights == pytest.approx(np.linalg.solve(design.T @ design + np.diag([0, 7.0, 7.0]), design.T @ y))


def test_classifiers_and_boosting_learn(spark):
    df = blobs(spark)
    accuracy = lambda rows, p: rows.agg(F.avg((F.col("g") == 1).eqNullSafe(p).cast("double"))).first()[0]
    positive = F.col("g") == 1
    assert accuracy(df, regressors.total_score(regressors.ada_boost(df, ["x", "y"], positive, 5)) > 0) > 0.98
    for rule in ("perceptron", "passive_aggressive"):
        assert accuracy(df, regressors.online(df, "id", ["x", "y"], positive, rule).score() > 0) > 0.97
    assert accuracy(df, regressors.ridge_classifier(df, ["x", "y"], positive).score() > 0) > 0.97
    choice = regressors.one_vs_rest(df, "g", lambda d, p: regressors.ridge_classifier(d, ["x", "y"], p))
    assert choice.predict(df).where(F.col("g").cast("string") != F.col("prediction")).count() == 0
    flags = df.withColumns({"a": (F.col("g") == 0).cast("int"), "b": (F.col("g") != 2).cast("int")})
    both = regressors.binary_relevance(flags, ["a", "b"], lambda d, p: regressors.ridge_classifier(d, ["x", "y"], p))
    assert set(both) == {"a", "b"} and flags.where((both["b"].score() > 0) != (F.col("b") == 1)).count() < 12
    target = df.withColumn("t", F.when(F.col("x") > 5, 4.0).otherwise(-1.0))
    stumps = regressors.boosted_stumps(target, ["x", "y"], "t", 30, 0.3, cuts=60)
    assert target.agg(F.avg(F.abs(F.col("t") - regressors.total_score(stumps)))).first()[0] < 0.1
    models = regressors.bagged(target, "id", lambda d, w: regressors.least_squares(d, ["x", "y"], "t", weight=w), 5)
    assert len({m.weights for m in models}) == 5


def test_ransac_ignores_outliers(spark):
    rng = random.Random(8)
    rows = [(i, float(i % 50), 2.0 * (i % 50) + 1 + rng.gauss(0, 0.1) + (500 if i % 4 == 0 else 0)) for i in range(400)]
    fit, inliers = regressors.ransac(spark.createDataFrame(rows, "id long, x double, y double"), "id", ["x"], "y", 1.0, trials=30, sample=3)
    assert fit.weights == pytest.approx((1.0, 2.0), abs=0.05) and inliers == 300


def test_resampled_scores_and_pooling(spark):
    df = blobs(spark)
    fit, score = lambda d: regressors.ridge_classifier(d, ["x", "y"], F.col("g") == 1), lambda m, d: d.agg(F.avg(((m.score() > 0) == (F.col("g") == 1)).cast("double"))).first()[0]
    assert min(regressors.holdout_scores(df, "id", "g", 0.25, 2, fit, score)) > 0.9
    assert [s for s, _ in regressors.learning_curve(df, "id", [0.5, 1.0], fit, score)] == [0.5, 1.0]
    assert regressors.pooled([1.0, 2.0, 3.0], [0.5, 0.5, 0.5]) == pytest.approx({"estimate": 2.0, "variance": 0.5 + 4 / 3, "missing": (4 / 3) / (0.5 + 4 / 3)})
    p = regressors.permutation_test(df, "id", "x", F.col("g") == 1, 19).first()
    assert p["p"] == pytest.approx(1 / 20) and p["difference"] > 9
    numbers = spark.range(20000).select(regressors.poisson(regressors.unit("id"), 2.0).alias("n")).agg(F.avg("n"), F.var_pop("n")).first()
    assert numbers[0] == pytest.approx(2.0, abs=0.05) and numbers[1] == pytest.approx(2.0, abs=0.1)


def test_fuzzy_and_value_set_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    words += [w[:-1] + "x" for w in words[:20]] + [words[0], None]
    rows = [(i, w, rng.choice(["red", "blue", None]), str(i % 3)) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string").repartition(3)

    def edits(s, t):
        row = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            row, before = [i], row
            for j, y in enumerate(t, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    alike = lambda s, t: 1.0 if not s and not t else 1 - edits(s or "", t or "") / max(len(s or ""), len(t or ""))
    for threshold, columns in ((0.8, (1,)), (0.6, (1,)), (0.7, (1, 2))):
        expected = {(p[0], q[0]): sum(alike(p[c], q[c]) for c in columns) / len(columns) for p in rows for q in rows if p[0] < q[0]}
        expected = {k: v for k, v in expected.items() if v >= threshold - 1e-12}
        got = {(r["a"], r["b"]): r["likeness"] for r in records.fuzzy_pairs(df, "id", ["_abc"[c] for c in columns], threshold).collect()}
        assert got == pytest.approx(expected), threshold
    sets = {r[0]: {v for v in r[1:] if v is not None} for r in rows}
    for threshold in (0.4, 0.5, 1.0):
        expected = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j and sets[i] and sets[j]}
        got = {(r["a"], r["b"]): r["jaccard"] for r in records.value_set_pairs(df, "id", ["a", "b", "c"], threshold).collect()}
        assert got == pytest.approx({k: v for k, v in expected.items() if v >= threshold - 1e-12})
    assert records.compare(df, "id", [0, 1], ["c"]).first()["same"] is False


def test_isolation_and_density_find_planted_outliers(spark):
    df = blobs(spark, 600, ((0.0, 0.0),)).unionByName(spark.createDataFrame([(10_000, 40.0, -40.0, 9), (10_001, None, 1.0, 9)], "id long, x double, y double, g int"))
    scored = outliers.isolation_scores(df, "id", ["x", "y"], 40, 128)
    assert scored.columns == [*df.columns, "score"] and scored.count() == 602
    assert scored.orderBy(F.desc("score")).first()["id"] == 10_000 and scored.where("score IS NULL").count() == 1
    flagged = outliers.density_outliers(df, "x", 0.01).where("is_outlier").collect()
    assert 10_000 in {r["id"] for r in flagged} and len(flagged) <= 7


def test_resampling_shapes(spark):
    df = blobs(spark, 120, ((0.0, 0.0), (0.5, 0.5), (0.3, 0.0), (0.1, 0.2))).withColumn("few", F.col("g") == 0)
    for version in (1, 2, 3):
        assert {r[0]: r[1] for r in resampling.near_miss(df, "id", ["x", "y"], "few", True, version).groupBy("few").count().collect()} == {True: 30, False: 30}
    quotas = resampling.adaptive_quotas(df, "id", ["x", "y"], "few", True).agg(F.sum("quota")).first()[0]
    made = resampling.adasyn(df, "id", ["x", "y"], "few", True)
    assert made.count() == quotas and abs(quotas - 60) <= 15 and made.where("few <> true").count() == 0
    assert resampling.borderline_smote(df, "id", ["x", "y"], "few", True).count() <= 30
    kept = resampling.condensed(df, "id", ["x", "y"], "few", True)
    assert kept.where("few").count() == 30 and kept.columns == df.columns
    far = blobs(spark).withColumn("noise", F.rand(3))
    weights = {r["name"]: r["weight"] for r in resampling.relief(far, "id", ["x", "noise"], "g", 3).collect()}
    assert weights["x"] > weights["noise"]


def test_bins_by_target(spark):
    rows = spark.createDataFrame([(float(i % 100), int((i % 100 > 30) != (i % 17 == 0))) for i in range(3000)], "x double, y int")
    edges = intervals.optimal_edges(rows, "x", "y", most=2, start=100)
    assert len(edges) == 3 and 30 <= edges[1] <= 32
    assert intervals.optimal_edges(rows, "x", "y", most=2, start=100, objective="gini")[1] == edges[1]
    up = intervals.monotonic_edges(rows, "x", "y", 20)
    means = [r["m"] for r in rows.groupBy(intervals.digitize(F.col("x"), up).alias("b")).agg(F.avg("y").alias("m")).orderBy("b").collect()]
    assert means == sorted(means)
    assert intervals.pooled_bins([(1, 0.0), (1, 1.0), (1, 0.0), (1, 1.0)]) == [0, 1, 3]
    assert len(intervals.k_means_edges(rows, "x", 4)) == 5


def test_searches_find_the_bottom():
    f = lambda p: (p["x"] - 2) ** 2 + (p["k"] != "b")
    space = {"x": (-5.0, 5.0), "k": ["a", "b", "c"]}
    assert seeking.check_space(space) == [] and len(seeking.check_space({"x": (3, 1), "k": []})) == 2
    point, value, history = seeking.parzen(space, f, 60, seed=1)
    assert value < 0.2 and point["k"] == "b" and len(history) == 60
    best, _ = seeking.hyperband(space, lambda p, budget: f(p) + 1 / budget)
    assert f(best) < 1.5
    point, value, history = seeking.successive_halving([{"x": v} for v in range(-9, 9)], lambda p, b: (p["x"] - 4) ** 2 / b, 1, 9)
    assert point == {"x": 4} and {b for _, b, _ in history} == {1, 3, 9}
    point, value = seeking.bayesian(lambda p: (p[0] - 0.3) ** 2 + (p[1] + 1) ** 2, [-2, -2], [2, 2], 30)
    assert value < 0.05
    assert seeking.ternary_search(lambda x: (x - 1.25) ** 2, -10, 10) == pytest.approx(1.25, abs=1e-4)
    assert seeking.best_first(0, lambda s: [s + 1, s - 1], lambda s: abs(s - 17), 200) == (17, 0)
    assert seeking.gradient_is_small([1e-9]) and seeking.population_has_met([2.0, 2.0]) and not seeking.population_has_met([1.0, 2.0])


def test_series_kernels_take_known_series():
    t = np.arange(140)
    x = 0.1 * t + 3 * np.sin(2 * np.pi * t / 7)
    trend, season, rest = kernels.seasonal_trend(x, 7)
    assert np.abs(trend - 0.1 * t)[10:-10].max() < 0.5 and np.abs(rest).max() < 1 and trend + season + rest == pytest.approx(x)
    forecast = kernels.seasonal_ar(7, 2, 1, 1)(x)
    assert np.nanmax(np.abs(forecast - x)) < 1e-6
    rng = np.random.default_rng(0)
    assert kernels.break_in_unit_root(np.where(t < 70, 0, 5) + rng.standard_normal(140)) < -5 < kernels.break_in_unit_root(np.cumsum(rng.standard_normal(140)))
    # Known: the ten weights of Shapiro and Wilk's first example.
    w, p = kernels.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=0.005) and p < 0.01
    assert kernels.shapiro_wilk(rng.standard_normal(500))[1] > 0.01 and kernels.shapiro_wilk(np.ones(5)) is None


def test_independent_components_unmix(spark):
    rng = np.random.default_rng(5)
    s = np.column_stack([np.sign(rng.standard_normal(3000)) * 1.0 + 0.1 * rng.standard_normal(3000), rng.random(3000)])
    x = s @ np.array([[1.0, 0.5], [0.7, 1.0]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    means, unmix = features.independent_components(df, ["a", "b"], 2)
    found = (x - means) @ unmix.T
    r = np.abs(np.corrcoef(found.T, s.T)[:2, 2:])
    assert r.max(axis=1).min() > 0.97


def test_stems_polarity_and_classes(spark):
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "rational": "ration", "triplicate": "triplic", "hopefulness": "hope", "electrical": "electr", "revival": "reviv", "adoption": "adopt", "probate": "probat", "controll": "control", "sky": "sky"}
    assert {w: tx.stem(w) for w in known} == known
    df = spark.createDataFrame([(1, "good not good bad"), (2, ""), (3, "running cats Running")], "id long, t string")
    got = {r["id"]: r["p"] for r in df.select("id", tx.polarity(F.split("t", " "), {"good": 1.0, "bad": -0.5}).alias("p")).collect()}
    assert got == pytest.approx({1: (1 - 1 - 0.5) / 3, 2: 0.0, 3: 0.0})
    stems = {r["id"]: r["stems"] for r in tx.stemmed(df, "id", F.split("t", " ")).collect()}
    assert stems[3] == ["run", "cat", "run"]


def test_base_shapes(spark):
    df = blobs(spark, 30)
    scale = base.Transformer(lambda d: d.agg(F.avg("x")).first()[0], lambda d, m: d.withColumn("x", F.col("x") - m), lambda d, m: d.withColumn("x", F.col("x") + m))
    with pytest.raises(RuntimeError):
        scale.transform(df)
    assert scale.fit_transform(df).agg(F.avg("x")).first()[0] == pytest.approx(0)
    assert scale.inverse_transform(scale.transform(df)).agg(F.sum("x")).first()[0] == pytest.approx(df.agg(F.sum("x")).first()[0])
    model = base.Model(lambda d: regressors.least_squares(d, ["x"], "y"), lambda y, p: F.avg((y - p) * (y - p)))
    assert model.fit(df).score(df, "y") >= 0
    verdict = base.validate(df, [base.Check("x is set", F.col("x").isNotNull()), base.Check("g below 2", F.col("g") < 2, allowed=0.1), base.Check("id even", F.col("id") % 2 == 0, mild=True)])
    assert not verdict.passed and len(verdict.errors) == 1 and len(verdict.warnings) == 1
    batch = base.Batch(df, ("x", "y"), "g", "id").with_features({"z": F.col("x") * 2}).only(["z"]).where("g = 1")
    assert batch.df.columns == ["id", "g", "z"] and batch.df.count() == 10
    with pytest.raises(ValueError):
        base.Batch(df, ("x", "nothing"))
    settings = base.Settings({"k": 3}, {"k": lambda v: v > 0})
    assert settings.changed(k=5).to_json() == '{"k": 5}'
    with pytest.raises(ValueError):
        settings.changed(k=0)
    assert base.TestResult(2.0, 0.01).rejects
