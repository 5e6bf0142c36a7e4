import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import control, models, optimizers, scaling


def test_pipeline_reuses_what_it_fitted(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    p = control.Pipeline([control.Step("z", fit=lambda d: scaling.fit_standard(d, ["x"])), control.Step("twice", transform=lambda d: d.withColumn("x", F.col("x") * 2))]).fit(df)
    assert [r["x"] for r in p.transform(spark.createDataFrame([(5.0,)], "x double")).collect()] == [6.0]


def test_artifacts_and_lineage(spark, tmp_path):
    a = control.Artifact("m", parameters={"k": 3}, metrics={"auc": 0.9})
    assert control.Artifact.from_json(a.to_json()) == a
    log = control.Lineage(spark, str(tmp_path / "lineage"))
    x = log.record("source", path="a")
    y = log.record("transformation", [x], name="scale")
    z = log.record("transformation", [y])
    assert log.ancestors(z) == [y, x]
    with pytest.raises(ValueError):
        log.record("other")


def test_tuning_and_folds(spark):
    assert len(list(control.grid({"a": [1, 2], "b": [3, 4, 5]}))) == 6
    best, value, history = control.tuned(control.grid({"a": [1, 2, 3]}), lambda p: (p["a"] - 2) ** 2)
    assert best == {"a": 2} and value == 0 and len(history) == 3
    df = spark.range(300).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("y"))
    scores = control.cross_validated(df, "id", 3, lambda d: models.fit_linear(d, ["x"], "y"), lambda m, d: m.predict(d).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0])
    assert len(scores) == 3 and max(scores) < 1e-6


def test_early_stopping():
    s = control.EarlyStop(patience=2)
    assert [s.stop(v) for v in (3, 2, 2, 2)] == [False, False, False, True]


def test_bandits_find_the_better_arm(spark):
    rng = random.Random(0)
    for bandit in (control.EpsilonGreedy(2), control.Thompson(2)):
        chosen = []
        for _ in range(600):
            arm = bandit.choose()
            chosen.append(arm)
            bandit.update(arm, int(rng.random() < (0.2, 0.7)[arm]))
        assert sum(chosen[300:]) > 200
    b = control.EpsilonGreedy(2)
    b.update_from(spark.createDataFrame([(0, 1.0), (1, 0.0), (0, 0.5)], "arm int, reward double"))
    assert b.counts == [2, 1] and b.totals == [1.5, 0.0]


def test_adaptive_window_sees_a_jump_and_no_other():
    rng = random.Random(1)
    w = control.AdaptiveWindow()
    cuts = [i for i in range(1000) if w.add(rng.gauss(0 if i < 500 else 5, 1))]
    assert cuts and min(cuts) >= 500 and min(cuts) < 560
    assert w.size <= 520


def test_optimisers_find_the_minimum():
    f = lambda x: (x[0] - 1) ** 2 + 2 * (x[1] + 2) ** 2
    g = lambda x: optimizers.numeric_gradient(f, x)
    for rule in ("sgd", "adagrad", "rmsprop", "adam"):
        assert optimizers.descend(g, [0.0, 0.0], rule, rate=0.5 if rule == "adagrad" else 0.05) == pytest.approx([1, -2], abs=0.06)
    for found in (optimizers.bfgs(f, [0.0, 0.0]), optimizers.evolve(f, 2, -5, 5), optimizers.swarm(f, 2, -5, 5), optimizers.cma(f, [0.0, 0.0])):
        assert found == pytest.approx([1, -2], abs=1e-3)


def test_gamma_likelihood_recovers_its_parameters(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.gammavariate(2.0, 3.0),) for _ in range(4000)], "x double")
    shape, scale = optimizers.gamma_likelihood(df, "x")
    assert shape == pytest.approx(2, rel=0.1) and scale == pytest.approx(3, rel=0.1)
