"""Queries of series kernels, neighbours, clusters, optimisers and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import charts as ch
from quarry.operators import kernels as k
from quarry.operators import neighbours as nb
from quarry.operators import optimizers as op
from quarry.plans.analysis import one_row, rounded
from quarry.plans.registry import query

ORDER = ["ts", "event_id"]


def _series(t):
    return t("events").select("user_id", "ts", "event_id", "value")


@query("series_kernels")
def _(t):
    f = {"hurst": k.hurst, "sample_entropy": k.sample_entropy(), "permutation_entropy": k.permutation_entropy(), "spectral_centroid": k.spectral_centroid, "dominant_period": k.dominant_period, "ar": k.ar_coefficient, "pettitt": k.pettitt, "mann_kendall": k.mann_kendall, "cuts": k.binary_segmentation(2000.0)}
    return k.per_series(_series(t), "user_id", ORDER, "value", f)


@query("holt_smoothing", "WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events), e(event_id, user_id, n, l, b) AS (SELECT event_id, user_id, n, value, 0.0::DOUBLE FROM o WHERE n = 1 UNION ALL SELECT o.event_id, o.user_id, o.n, 0.4 * o.value + 0.6 * (e.l + e.b), 0.2 * (0.4 * o.value + 0.6 * (e.l + e.b) - e.l) + 0.8 * e.b FROM e JOIN o ON o.user_id = e.user_id AND o.n = e.n + 1) SELECT event_id, round(l, 6) AS level FROM e")
def _(t):
    return rounded(k.transformed(_series(t), "user_id", ORDER, "value", k.holt(0.4, 0.2), "level").select("event_id", "level"))


@query("holt_winters")
def _(t):
    return k.transformed(_series(t), "user_id", ORDER, "value", k.holt_winters(0.4, 0.1, 0.2, 7), "forecast").select("event_id", "forecast")


@query("median_filter")
def _(t):
    return k.transformed(_series(t), "user_id", ORDER, "value", k.median_filter(5), "filtered").select("event_id", "filtered")


@query("savitzky_golay")
def _(t):
    return k.transformed(_series(t), "user_id", ORDER, "value", k.savitzky_golay(7, 2), "smoothed").select("event_id", "smoothed")


_DIST = "WITH c AS (SELECT p_partkey id, p_size::DOUBLE x, p_retailprice / 100 y FROM part), d AS (SELECT a.id AS query, b.id AS id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) d FROM c a JOIN c b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) n FROM d)"


def _parts(t):
    return t("part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), "p_brand")


@query("nearest_neighbours", _DIST + " SELECT query, n::INTEGER AS rank, round(d, 5) AS distance FROM r WHERE n <= 3")
def _(t):
    p = _parts(t)
    return nb.nearest(p, p, "p_partkey", ["x", "y"], 3).select("query", "rank", F.round("distance", 5).alias("distance"))


@query("knn_impute", "WITH c AS (SELECT p_partkey id, p_size::DOUBLE x, p_retailprice / 100 y, CASE WHEN p_partkey % 20 <> 0 THEN p_size * 2.0 END v FROM part), d AS (SELECT a.id AS query, b.id, b.v, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) n FROM c a JOIN c b ON a.v IS NULL AND b.v IS NOT NULL), m AS (SELECT query, avg(v) v FROM d WHERE n <= 5 GROUP BY 1) SELECT id AS p_partkey, round(coalesce(c.v, m.v), 5) AS v FROM c LEFT JOIN m ON query = id")
def _(t):
    p = _parts(t).withColumn("v", F.when(F.col("p_partkey") % 20 != 0, F.col("x") * 2))
    return nb.knn_impute(p, "p_partkey", ["x", "y"], "v", 5).select("p_partkey", F.round("v", 5).alias("v"))


for _name, _f in (
    ("knn_classify", lambda p: nb.knn_classify(p.where("p_partkey % 5 <> 0"), p.where("p_partkey % 5 = 0"), "p_partkey", ["x", "y"], "p_brand", 5)),
    ("edited_neighbours", lambda p: nb.edited(p, "p_partkey", ["x", "y"], "p_brand", 3).select("p_partkey")),
    ("tomek_links", lambda p: nb.tomek_links(p, "p_partkey", ["x", "y"], "p_brand")),
    ("smote", lambda p: nb.smote(p.withColumn("few", F.col("p_partkey") % 10 == 0), "p_partkey", ["x", "y"], "few", True)),
    ("local_outlier_factor", lambda p: nb.local_outlier_factor(p, "p_partkey", ["x", "y"])),
    ("density_clusters", lambda p: nb.density_clusters(p, "p_partkey", "x", "y", 0.7, 4)),
):
    query(_name)(lambda t, f=_f: f(_parts(t)))


@query("k_medians")
def _(t):
    p = _parts(t)
    return p.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(nb.k_medians(p, ["x", "y"], 3))], "cluster int, x double, y double")


@query("gamma_likelihood")
def _(t):
    shape, scale = op.gamma_likelihood(t("orders"), "o_totalprice")
    return one_row(t("orders"), {"shape": shape, "scale": scale})


@query("distributed_minimum", "SELECT round(regr_slope(l_extendedprice / 1000, l_quantity), 3) AS slope FROM lineitem")
def _(t):
    x = t("lineitem")
    loss = op.distributed(x, lambda p: F.pow(F.col("l_extendedprice") / 1000 - p[0] - p[1] * F.col("l_quantity"), 2))
    return x.sparkSession.createDataFrame([(round(float(op.bfgs(loss, [0.0, 0.0], rounds=12, tolerance=1e-5)[1]), 3),)], "slope double")


# Charts

_HIST = "WITH m AS (SELECT min(o_totalprice) a, max(o_totalprice) b FROM orders), d AS (SELECT least(list_sum(list_transform(range(1, 12), lambda i: CAST(o_totalprice >= a + (b - a) * i / 12 AS INTEGER))), 11) bin FROM orders, m), g AS (SELECT bin, count(*) n FROM d GROUP BY 1) SELECT i::INTEGER AS bin, coalesce(n, 0) AS n, round(a + (b - a) * i / 12, 4) AS low FROM (SELECT unnest(range(12)) i) LEFT JOIN g ON bin = i, m"


@query("chart_histogram", _HIST)
def _(t):
    return ch.histogram(t("orders"), "o_totalprice", 12).select("bin", "n", F.round("low", 4).alias("low"))


@query("chart_box", "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) q1, median(value) m, quantile_cont(value, 0.75) q3 FROM events GROUP BY 1) SELECT event_type, round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM events JOIN q USING (event_type) GROUP BY ALL")
def _(t):
    return rounded(ch.box_stats(t("events"), "value", ["event_type"]))


@query("chart_grid")
def _(t):
    return ch.grid_counts(t("lineitem"), "l_quantity", "l_discount", 10, 5)


@query("chart_normal_quantiles", "WITH p AS (SELECT unnest(list_transform(range(20), lambda i: (i + 0.5) / 20)) p) SELECT round(p, 6) AS p, round((SELECT quantile_cont(c_acctbal, list_transform(range(20), lambda i: CAST((i + 0.5) / 20 AS DOUBLE))) FROM customer)[CAST(floor(p * 20) AS INTEGER) + 1], 2) AS sample FROM p")
def _(t):
    return ch.normal_quantiles(t("customer"), "c_acctbal", 20).select(F.round("p", 6).alias("p"), F.round("sample", 2).alias("sample"))


@query("chart_density")
def _(t):
    return ch.density(t("orders"), "o_totalprice")


@query("chart_pareto", "WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, n, round(sum(n) OVER (ORDER BY n DESC, p_brand) / sum(n) OVER (), 8) AS share FROM c")
def _(t):
    return rounded(ch.pareto(t("part"), "p_brand"), 8)


@query("chart_calibration", "WITH b AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END y, l_quantity / 50 p FROM lineitem) SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 8) AS predicted, round(avg(y), 8) AS observed FROM b GROUP BY 1")
def _(t):
    return rounded(ch.calibration(t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("p")), "y", "p"), 8)


@query("drift_points")
def _(t):
    from quarry.operators.control import drift_points

    return drift_points(_series(t).withColumn("value", F.when(F.col("user_id") % 2 == 0, F.col("value") + 100 * (F.col("ts") > F.lit("2024-01-15").cast("timestamp_ntz")).cast("int")).otherwise(F.col("value"))), "user_id", ORDER, "value")


# Selection and model-based imputation

_LINE = ["l_quantity", "l_discount", "l_tax"]


@query("forward_selection")
def _(t):
    from quarry.operators.selection import forward

    x = t("lineitem")
    return x.sparkSession.createDataFrame(forward(x, _LINE, "l_extendedprice", 3), "name string, r2 double")


@query("backward_selection")
def _(t):
    from quarry.operators.selection import backward

    x = t("lineitem")
    return x.sparkSession.createDataFrame([(c,) for c in backward(x, _LINE, "l_extendedprice", 2)], "name string")


@query("shapley_selection")
def _(t):
    from quarry.operators.selection import shapley

    x = t("lineitem")
    return x.sparkSession.createDataFrame(shapley(x, _LINE, "l_extendedprice"), "name string, value double")


@query("regression_imputation")
def _(t):
    from quarry.operators.imputers import by_regression

    p = _parts(t).withColumn("v", F.when(F.col("p_partkey") % 9 != 0, F.col("x") * 2 + F.col("y")))
    return by_regression(p.select("p_partkey", "x", "y", "v"), ["x", "y", "v"])


@query("normal_imputation")
def _(t):
    from quarry.operators.imputers import by_normal_law

    p = _parts(t).withColumn("v", F.when(F.col("p_partkey") % 9 != 0, F.col("x") * 2 + F.col("y")))
    return by_normal_law(p.select("p_partkey", "x", "y", "v"), ["x", "y", "v"])
