import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import embedding, imputers, selection


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    return spark.createDataFrame([(i, *map(float, r), float(3 * r[0] - r[2] + 0.01 * e)) for i, (r, e) in enumerate(zip(x, rng.normal(size=400), strict=True))], "id long, a double, b double, c double, y double")


def test_selection_finds_the_columns_that_matter(line):
    assert [c for c, _ in selection.forward(line, ["a", "b", "c"], "y", 2)] == ["a", "c"]
    assert selection.backward(line, ["a", "b", "c"], "y", 2) == ["a", "c"]
    s = dict(selection.shapley(line, ["a", "b", "c"], "y"))
    assert s["a"] > s["c"] > abs(s["b"]) and sum(s.values()) == pytest.approx(1, abs=0.01)
    assert dict(selection.stable(line, "id", ["a", "b", "c"], "y", 2, rounds=3)) == {"a": 1.0, "b": 0.0, "c": 1.0}
    assert selection.sparse(line, ["a", "b", "c"], "y", 0.2) == ["a", "c"]


def test_shuffled_columns_keep_their_values(line):
    s = selection.with_shuffled(line, "id", "a")
    assert sorted(r["a"] for r in s.collect()) == sorted(r["a"] for r in line.collect())
    assert s.join(line.select("id", F.col("a").alias("was")), "id").where("a <> was").count() > 300


@pytest.mark.parametrize("how", [imputers.by_regression, imputers.by_normal_law])
def test_imputation_from_other_columns(line, how):
    gaps = line.select("id", "a", "c", F.when(F.col("id") % 5 != 0, F.col("y")).alias("y"))
    filled = how(gaps, ["a", "c", "y"]).join(line.select("id", F.col("y").alias("was")), "id")
    assert filled.agg(F.max(F.abs(F.col("y") - F.col("was")))).first()[0] < 0.2


def test_matrix_completion_restores_a_low_rank():
    rng = np.random.default_rng(1)
    x = np.outer(rng.normal(size=30), rng.normal(size=12))
    holes = np.where(rng.random(x.shape) < 0.2, np.nan, x)
    got = imputers.complete_matrix(pd.DataFrame(holes), shrink=0.05, rounds=500).to_numpy()
    assert np.abs(got - x).max() < 0.3


def test_maps_keep_two_groups_apart():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.2, (40, 4)), rng.normal(3, 0.2, (40, 4))])
    for f in (lambda v: embedding.classical_scaling(embedding.distances(v), 1), lambda v: embedding.diffusion_map(v, 1), lambda v: embedding.isomap(v, 1), lambda v: embedding.spread_neighbours(v, 1, perplexity=15)):
        y = f(x)[:, 0]
        assert max(y[:40].max() < y[40:].min(), y[:40].min() > y[40:].max())
    for labels in (embedding.mean_shift(x, 1.5), embedding.affinity(x)):
        assert not set(labels[:40]) & set(labels[40:])
