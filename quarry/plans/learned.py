"""Queries of clusters, regressors, records, resampling, outliers and what series and charts add."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quarry.operators import charts as ch
from quarry.operators import clusters as c
from quarry.operators import features as fe
from quarry.operators import intervals as iv
from quarry.operators import kernels as k
from quarry.operators import outliers as o
from quarry.operators import records as rec
from quarry.operators import regressors as rg
from quarry.operators import relational as r
from quarry.operators import resampling as rs
from quarry.operators import text as tx
from quarry.plans.analysis import one_row, rounded
from quarry.plans.registry import query
from quarry.plans.relational import h

ORDER = ["ts", "event_id"]
ONE = "1152921504606846976.0"


def _parts(t):
    return t("part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), "p_brand", (F.col("p_partkey") % 10 == 0).alias("few"))


def _pairs(t, rows, kinds):
    return t.sparkSession.createDataFrame(rows, kinds)


# Regressors

_XY = "WITH s AS (SELECT count(*) n, regr_slope(y, x) b, regr_intercept(y, x) a, regr_sxx(y, x) sxx, regr_syy(y, x) syy, regr_sxy(y, x) sxy, avg(x) mx, avg(y) my FROM (SELECT l_extendedprice / 1000 y, l_quantity x FROM lineitem))"


def _line(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x"))


@query("least_squares", _XY + ", e AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) v FROM s) SELECT '(intercept)' AS name, round(a, 5) AS weight, round(sqrt(v * (1 / n + mx * mx / sxx)), 6) AS error FROM e UNION ALL SELECT 'x', round(b, 5), round(sqrt(v / sxx), 6) FROM e")
def _(t):
    f = rg.least_squares(_line(t), ["x"], "y")
    return f.table(t("lineitem")).select("name", F.round("weight", 5).alias("weight"), F.round("error", 6).alias("error"))


@query("ridge_regression", _XY + " SELECT round(sxy / (sxx + 5000), 6) AS slope, round(my - sxy / (sxx + 5000) * mx, 5) AS intercept FROM s")
def _(t):
    f = rg.least_squares(_line(t), ["x"], "y", ridge=5000.0)
    return _pairs(t("lineitem"), [(round(f.weights[1], 6), round(f.weights[0], 5))], "slope double, intercept double")


@query("ridge_classifier", "WITH d AS (SELECT l_returnflag, l_quantity x, CASE WHEN l_extendedprice > 30000 THEN 1.0 ELSE -1.0 END y FROM lineitem), s AS (SELECT regr_sxy(y, x) / (regr_sxx(y, x) + 1) b, avg(y) my, avg(x) mx FROM d) SELECT l_returnflag, count(*) FILTER (my + b * (x - mx) > 0) AS positive FROM d, s GROUP BY 1")
def _(t):
    x = t("lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), "l_extendedprice")
    f = rg.ridge_classifier(x, ["x"], F.col("l_extendedprice") > 30000)
    return f.predict(x).groupBy("l_returnflag").agg(F.count_if(F.col("prediction") > 0).alias("positive"))


@query("logistic_regression", "WITH c AS (SELECT count(*) FILTER (x = 0 AND y = 1)::DOUBLE a, count(*) FILTER (x = 0 AND y = 0)::DOUBLE b, count(*) FILTER (x = 1 AND y = 1)::DOUBLE c, count(*) FILTER (x = 1 AND y = 0)::DOUBLE d FROM (SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END x, CASE WHEN l_extendedprice > 30000 THEN 1 ELSE 0 END y FROM lineitem) WHERE true) SELECT '(intercept)' AS name, round(ln((a + 0) / b), 4) AS weight, round(sqrt(1 / a + 1 / b), 4) AS error FROM c UNION ALL SELECT 'x', round(ln(c / d) - ln(a / b), 4), round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 4) FROM c")
def _(t):
    x = t("lineitem").select((F.col("l_quantity") > 25).cast("int").alias("x"), (F.col("l_extendedprice") > 30000).cast("int").alias("y"))
    return rg.logistic(x, ["x"], "y").table(x).select("name", F.round("weight", 4).alias("weight"), F.round("error", 4).alias("error"))


query("normal_fit", "SELECT count(*) AS n, round(avg(o_totalprice), 5) AS mean, round(stddev_pop(o_totalprice) / sqrt(count(*)), 5) AS mean_error, round(stddev_pop(o_totalprice), 5) AS deviation, round(stddev_pop(o_totalprice) / sqrt(2 * count(*)), 5) AS deviation_error FROM orders")(lambda t: rounded(rg.normal_fit(t("orders"), "o_totalprice"), 5))
query("exponential_fit", "SELECT count(*) AS n, round(1 / avg(o_totalprice), 12) AS rate, round(1 / avg(o_totalprice) / sqrt(count(*)), 12) AS rate_error, round(-count(*) * (ln(avg(o_totalprice)) + 1), 4) AS log_likelihood FROM orders WHERE o_totalprice > 0")(
    lambda t: rg.exponential_fit(t("orders"), "o_totalprice").select("n", F.round("rate", 12).alias("rate"), F.round("rate_error", 12).alias("rate_error"), F.round("log_likelihood", 4).alias("log_likelihood"))
)
query("jackknife_mean", "SELECT count(*) AS n, round(avg(c_acctbal), 6) AS estimate, round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS error FROM customer")(lambda t: rounded(rg.jackknife_mean(t("customer"), "c_acctbal").drop("bias")))


def _poisson_sql(u: str, rate: float) -> str:
    """How many of the law's cumulative probabilities u reaches."""
    terms, p, total = [], math.exp(-rate), math.exp(-rate)
    for i in range(1, 60):
        terms.append(f"CASE WHEN {u} >= {total!r} THEN 1 ELSE 0 END")
        p *= rate / i
        total += p
        if 1 - total < 1e-12:
            break
    return "(" + " + ".join(terms) + ")"


query("poisson_numbers", f"SELECT c_custkey, {_poisson_sql(h('c_custkey', 3) + ' / ' + ONE, 2.5)} AS n FROM customer")(lambda t: t("customer").select("c_custkey", rg.poisson(rg.unit("c_custkey", 3), 2.5).alias("n")))
query("bootstrap_means", f"WITH e AS (SELECT c_acctbal x, r, CAST('0x' || substr(md5(c_custkey || ':' || (5 + r)), 1, 15) AS BIGINT) / {ONE} u FROM customer, (SELECT CAST(unnest(range(8)) AS INTEGER) r)), w AS (SELECT r, x, {_poisson_sql('u', 1.0)} w FROM e) SELECT r AS round, round(sum(w * x) / sum(w), 6) AS mean FROM w GROUP BY 1")(lambda t: rounded(rg.bootstrap_means(t("customer"), "c_custkey", "c_acctbal", 8, 5)))


@query("permutation_test", "WITH d AS (SELECT c_custkey i, c_acctbal x, c_nationkey < 10 a FROM customer), s AS (SELECT count(*) n, count(*) FILTER (a) m, avg(x) FILTER (a) - avg(x) FILTER (NOT a) d FROM d), o AS (SELECT r, x, row_number() OVER (PARTITION BY r ORDER BY CAST('0x' || substr(md5(i || ':' || (2 + r)), 1, 15) AS BIGINT), i) p FROM d, (SELECT CAST(unnest(range(9)) AS INTEGER) r)), q AS (SELECT r, avg(x) FILTER (p <= m) - avg(x) FILTER (p > m) v FROM o, s GROUP BY 1) SELECT max(n) AS n, round(max(d), 6) AS difference, (count(*) FILTER (abs(v) >= abs(d)) + 1) / (count(*) + 1) AS p FROM q, s")
def _(t):
    return rounded(rg.permutation_test(t("customer"), "c_custkey", "c_acctbal", F.col("c_nationkey") < 10, 9, 2))


for _name, _f in (
    ("boosted_stumps", lambda t: _pairs(t("part"), [(s.column, float(s.cut), round(s.low, 6), round(s.high, 6)) for s in rg.boosted_stumps(_parts(t), ["x", "y"], "p_partkey", 6)], "name string, cut double, low double, high double")),
    ("ada_boost", lambda t: _pairs(t("part"), [(s.column, float(s.cut), round(s.low, 6)) for s in rg.ada_boost(_parts(t), ["x", "y"], F.col("x") + 2 * F.col("y") > 50, 6)], "name string, cut double, low double")),
    ("ransac", lambda t: _pairs(t("lineitem"), [(f.n, n, round(f.weights[1], 5)) for f, n in [rg.ransac(_line(t).withColumn("i", F.col("l_orderkey") * 8 + F.col("l_linenumber")), "i", ["x"], "y", 10.0, 10)]], "n long, inliers long, slope double")),
    ("online_learning", lambda t: _pairs(t("part"), [(c_ or "(intercept)", round(w, 6)) for f in [rg.online(_parts(t), "p_partkey", ["x", "y"], F.col("x") > 25, epochs=2)] for c_, w in zip(f.names, f.weights, strict=True)], "name string, weight double")),
    ("one_vs_rest", lambda t: rg.one_vs_rest(t("lineitem"), "l_returnflag", lambda d, p: rg.ridge_classifier(d, ["l_quantity", "l_tax"], p)).predict(t("lineitem")).groupBy("l_returnflag", "prediction").agg(F.count("*").alias("n"))),
    ("bagging", lambda t: _line(t).select("l_orderkey", "l_linenumber", rg.mean_score(rg.bagged(_line(t), "l_orderkey", lambda d, w: rg.least_squares(d, ["x"], "y", weight=w), 5)).alias("prediction"))),
    ("cox_regression", lambda t: rg.cox(t("orders").withColumn("time", F.datediff(F.lit("1999-01-01"), F.col("o_orderdate"))).withColumn("done", (F.col("o_orderstatus") == "F").cast("int")).withColumn("price", F.col("o_totalprice") / 100000), ["price"], "time", "done", rounds=6).table(t("orders"))),
):
    query(_name)(lambda t, f=_f: f(t))

# Clusters

_START = ((5.0, 9.5), (25.0, 11.0), (45.0, 13.0))


def _k_means_sql(rounds: int) -> str:
    sql = "WITH p AS (SELECT p_size::DOUBLE x, p_retailprice / 100 y FROM part), c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_START)) + ") v(i, a, b))"
    for n in range(rounds):
        sql += f", a{n} AS (SELECT x, y, arg_min(i, (x - a) ** 2 + (y - b) ** 2) i FROM p, c{n} GROUP BY x, y, rowid_), c{n + 1} AS (SELECT i, avg(x) a, avg(y) b FROM a{n} GROUP BY 1)"
    sql = sql.replace("p AS (SELECT p_size::DOUBLE x", "p AS (SELECT p_partkey rowid_, p_size::DOUBLE x")
    return sql + f" SELECT i::INTEGER AS cluster, round(a, 5) AS x, round(b, 5) AS y FROM c{rounds}"


@query("k_means", _k_means_sql(3))
def _(t):
    f = c.k_means(_parts(t), c.Centres(("x", "y"), _START), rounds=3, tolerance=0.0)
    return _pairs(t("part"), [(i, round(a, 5), round(b, 5)) for i, (a, b) in enumerate(f.points)], "cluster int, x double, y double")


query("initial_centres", f"SELECT round(p_size, 5) AS x, round(p_retailprice / 100, 5) AS y FROM part ORDER BY {h('p_partkey', 4)}, p_partkey LIMIT 4")(
    lambda t: _pairs(t("part"), [(round(a, 5), round(b, 5)) for a, b in c.initial_centres(_parts(t), "p_partkey", ["x", "y"], 4, "random", 4).points], "x double, y double")
)
_FUZZY = "WITH p AS (SELECT p_size::DOUBLE x, p_retailprice / 100 y FROM part), d AS (SELECT x, y, greatest((x - 5) ** 2 + (y - 9.5) ** 2, 1e-12) a, greatest((x - 25) ** 2 + (y - 11) ** 2, 1e-12) b FROM p), u AS (SELECT x, y, (b / (a + b)) ** 2 u, (a / (a + b)) ** 2 v FROM d) SELECT 0 AS cluster, round(sum(u * x) / sum(u), 5) AS x, round(sum(u * y) / sum(u), 5) AS y FROM u UNION ALL SELECT 1, round(sum(v * x) / sum(v), 5), round(sum(v * y) / sum(v), 5) FROM u"


@query("fuzzy_means", _FUZZY)
def _(t):
    f = c.fuzzy_means(_parts(t), c.Centres(("x", "y"), _START[:2]), rounds=1)
    return _pairs(t("part"), [(i, round(a, 5), round(b, 5)) for i, (a, b) in enumerate(f.points)], "cluster int, x double, y double")


@query("voronoi_cells", "WITH d AS (SELECT p_partkey, (p_size - 5) ** 2 + (p_retailprice / 100 - 9.5) ** 2 a, (p_size - 25) ** 2 + (p_retailprice / 100 - 11) ** 2 b, (p_size - 45) ** 2 + (p_retailprice / 100 - 13) ** 2 c FROM part) SELECT p_partkey, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS cell FROM d")
def _(t):
    return fe.voronoi(_parts(t), F.col("x"), F.col("y"), _START).select("p_partkey", "cell")


for _name, _f in (
    ("gap_statistic", lambda t: _pairs(t("supplier"), [(n, round(g, 6), round(s, 6)) for n, g, s in c.gap_statistic(t("customer"), "c_custkey", ["c_acctbal"], [1, 2], references=2)], "k int, gap double, deviation double")),
    ("possibilistic_means", lambda t: _pairs(t("part"), [(i, round(a, 6), round(b, 6)) for i, (a, b) in enumerate(c.fuzzy_means(_parts(t), c.Centres(("x", "y"), _START), rounds=3, typicality=2.0).points)], "cluster int, x double, y double")),
    ("divisive_clusters", lambda t: c.divisive(_parts(t), "p_partkey", ["x", "y"], 3).predict(_parts(t)).groupBy("cluster").agg(F.count("*").alias("n"))),
    ("agglomerative_ward", lambda t: c.agglomerative(t("nation").withColumn("r", F.col("n_regionkey") * 10), ["n_nationkey", "r"], 4).select("n_nationkey", "cluster")),
    ("agglomerative_average", lambda t: c.agglomerative(t("nation").withColumn("r", F.col("n_regionkey") * 10), ["n_nationkey", "r"], 4, "average").select("n_nationkey", "cluster")),
    ("birch_clusters", lambda t: c.birch(_parts(t), ["x", "y"], 5, 2.0).groupBy("cluster").agg(F.count("*").alias("n"))),
    ("evidence_clusters", lambda t: c.evidence_clusters(_parts(t), [c.k_means(_parts(t), c.initial_centres(_parts(t), "p_partkey", ["x", "y"], n, "random", n), 4) for n in (3, 4)], 3).groupBy("cluster").agg(F.count("*").alias("n"))),
    ("markov_clusters", lambda t: c.markov_clusters(t("nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 5) % 25).alias("dst"), F.lit(1.0).alias("w")), rounds=4)),
):
    query(_name)(lambda t, f=_f: f(t))

# Records

query("compare_records", "SELECT * FROM (SELECT 'n_regionkey' AS field, count(DISTINCT n_regionkey) <= 1 AS same FROM nation WHERE n_nationkey IN (1, 2, 3) UNION ALL SELECT 'n_name', count(DISTINCT n_name) <= 1 FROM nation WHERE n_nationkey IN (1, 2, 3))")(lambda t: rec.compare(t("nation"), "n_nationkey", [1, 2, 3], ["n_regionkey", "n_name"]).select("field", "same"))
query("fuzzy_pairs", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 6) AS likeness FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE 1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)) >= 0.55 - 1e-12")(lambda t: rounded(rec.fuzzy_pairs(t("nation"), "n_nationkey", ["n_name"], 0.55)))
_SETS = "WITH s AS (SELECT p_partkey i, [p_brand, p_type, p_size::VARCHAR] s FROM part), q AS (SELECT a.i AS a, b.i AS b, len(list_filter(a.s, lambda v: list_contains(b.s, v))) k FROM s a JOIN s b ON a.i < b.i) SELECT a, b, round(k / (6 - k), 6) AS jaccard FROM q WHERE k / (6 - k) >= 0.5 - 1e-12"
query("value_set_pairs", _SETS)(lambda t: rec.value_set_pairs(t("part"), "p_partkey", ["p_brand", "p_type", "p_size"], 0.5, places=6))
query("drop_similar_records", "SELECT a.p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey < a.p_partkey AND b.p_brand = a.p_brand AND b.p_type = a.p_type AND b.p_size = a.p_size)")(lambda t: rec.drop_similar(t("part"), "p_partkey", ["p_brand", "p_type", "p_size"], 0.9).select("p_partkey"))
query("fuzzy_groups")(lambda t: rec.fuzzy_groups(t("nation"), "n_nationkey", ["n_name"], 0.55))

# Resampling

_P = "p AS (SELECT p_partkey i, p_size::DOUBLE x, p_retailprice / 100 y, p_partkey % 10 = 0 few FROM part)"
_NEAR = f"WITH {_P}, d AS (SELECT a.i q, b.i i, b.few l, row_number() OVER (PARTITION BY a.i ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.i) n, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) d FROM p a JOIN p b ON a.i <> b.i AND "
query("near_miss", _NEAR + "NOT a.few AND b.few), f AS (SELECT q, avg(d) d FROM d WHERE n <= 3 GROUP BY 1), g AS (SELECT q, row_number() OVER (ORDER BY round(d, 9), q) n FROM f) SELECT i AS p_partkey FROM p WHERE few UNION ALL SELECT q FROM g WHERE n <= (SELECT count(*) FROM p WHERE few)")(lambda t: rs.near_miss(_parts(t), "p_partkey", ["x", "y"], "few", True).select("p_partkey"))
query("adaptive_quotas", _NEAR + "a.few), s AS (SELECT q, avg(CASE WHEN NOT l THEN 1.0 ELSE 0.0 END) r FROM d WHERE n <= 5 GROUP BY 1) SELECT q AS query, CAST(round(r / (SELECT sum(r) FROM s) * (SELECT count(*) FILTER (NOT few) - count(*) FILTER (few) FROM p)) AS BIGINT) AS quota FROM s")(lambda t: rs.adaptive_quotas(_parts(t), "p_partkey", ["x", "y"], "few", True))
query("border_kinds", _NEAR + "a.few), s AS (SELECT q, avg(CASE WHEN NOT l THEN 1.0 ELSE 0.0 END) r FROM d WHERE n <= 10 GROUP BY 1) SELECT q AS query, CASE WHEN r >= 1 THEN 'noise' WHEN r >= 0.5 THEN 'danger' ELSE 'safe' END AS kind FROM s")(lambda t: rs.border_kinds(_parts(t), "p_partkey", ["x", "y"], "few", True))
for _name, _f in (
    ("near_miss_2", lambda p: rs.near_miss(p, "p_partkey", ["x", "y"], "few", True, 2).select("p_partkey")),
    ("near_miss_3", lambda p: rs.near_miss(p, "p_partkey", ["x", "y"], "few", True, 3).select("p_partkey")),
    ("adasyn", lambda p: rs.adasyn(p, "p_partkey", ["x", "y"], "few", True)),
    ("borderline_smote", lambda p: rs.borderline_smote(p, "p_partkey", ["x", "y"], "few", True)),
    ("condensed_neighbours", lambda p: rs.condensed(p, "p_partkey", ["x", "y"], "few", True, rounds=6).select("p_partkey")),
    ("relief", lambda p: rs.relief(p, "p_partkey", ["x", "y"], "few", 3)),
):
    query(_name)(lambda t, f=_f: f(_parts(t)))

# Outliers and bins

_DIXON = "[" + ", ".join(map(str, o.DIXON_95)) + "]"
query("dixon_q", f"WITH s AS (SELECT o_custkey, list_sort(list(o_totalprice)) l, count(*) n FROM orders GROUP BY 1 HAVING count(*) BETWEEN 3 AND 30), q AS (SELECT o_custkey, n, CASE WHEN l[n] > l[1] THEN (l[2] - l[1]) / (l[n] - l[1]) ELSE 0 END a, CASE WHEN l[n] > l[1] THEN (l[n] - l[n - 1]) / (l[n] - l[1]) ELSE 0 END b FROM s) SELECT o_custkey, n, round(a, 6) AS low_q, round(b, 6) AS high_q, a > {_DIXON}[n - 2] AS low_out, b > {_DIXON}[n - 2] AS high_out FROM q")(lambda t: rounded(o.dixon_q(t("orders"), "o_totalprice", ["o_custkey"])))
query("isolation_forest")(lambda t: o.isolation_scores(_parts(t), "p_partkey", ["x", "y"], 20, 64).select("p_partkey", "score"))
query("density_outliers")(lambda t: o.density_outliers(t("orders"), "o_totalprice", 0.02).groupBy("is_outlier").agg(F.count("*").alias("n")))
for _name, _f in (
    ("bin_k_means", lambda x: iv.k_means_edges(x, "l_extendedprice", 5)),
    ("bin_monotonic", lambda x: iv.monotonic_edges(x, "l_extendedprice", "late", 12)),
    ("bin_optimal", lambda x: iv.optimal_edges(x, "l_extendedprice", "late", 4, 20, least=5)),
):
    query(_name)(lambda t, f=_f: _pairs(t("lineitem"), [(i, float(e)) for i, e in enumerate(f(t("lineitem").withColumn("late", (F.col("l_quantity") > 30).cast("int"))))], "place int, edge double"))

# Series

_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def _events(t):
    return t("events").select("user_id", "ts", "event_id", "value")


query("fourier_coefficients", f"WITH s AS (SELECT user_id, value x, row_number() OVER {_W} - 1 t, count(*) OVER (PARTITION BY user_id) n FROM events WHERE value IS NOT NULL), e AS (SELECT user_id, k, sum(x * cos(2 * pi() * k * t / n)) re, -sum(x * sin(2 * pi() * k * t / n)) im FROM s, (SELECT CAST(unnest([1, 2]) AS INTEGER) k) GROUP BY 1, 2) SELECT user_id, k, round(re, 4) AS re, round(im, 4) AS im, round(sqrt(re * re + im * im), 4) AS size FROM e")(lambda t: rounded(fe.fourier_coefficients(_events(t), "value", ["user_id"], ORDER, [1, 2]), 4))
query("series_features", f"WITH s AS (SELECT user_id, value x, value - lag(value) OVER {_W} d, avg(value) OVER (PARTITION BY user_id) m, row_number() OVER {_W} - 1 i, ts, event_id FROM events WHERE value IS NOT NULL), u AS (SELECT *, CASE WHEN (x > m) <> lag(x > m) OVER {_W} THEN 1 ELSE 0 END c FROM s) SELECT user_id, count(*) AS n, round(avg(x), 5) AS mean, round(var_pop(x), 5) AS variance, round(sum(x * x), 4) AS energy, round(avg(abs(d)), 5) AS mean_abs_change, round(avg(d), 5) AS mean_change, round(sum(abs(d)), 4) AS path, count(*) FILTER (x > m) AS above_mean, CAST(sum(c) AS BIGINT) AS crossings, max(x) AS highest, min(x) AS lowest, round(min(i) FILTER (x = hi) / count(*), 6) AS first_highest, round(min(i) FILTER (x = lo) / count(*), 6) AS first_lowest FROM (SELECT *, max(x) OVER (PARTITION BY user_id) hi, min(x) OVER (PARTITION BY user_id) lo FROM u) GROUP BY 1")(
    lambda t: fe.series_features(_events(t), "value", ["user_id"], ORDER).select("user_id", "n", *(F.round(x, 5).alias(x) for x in ("mean", "variance", "mean_abs_change", "mean_change")), *(F.round(x, 4).alias(x) for x in ("energy", "path")), "above_mean", "crossings", "highest", "lowest", F.round("first_highest", 6).alias("first_highest"), F.round("first_lowest", 6).alias("first_lowest"))
)
query("climbs", f"WITH d AS (SELECT user_id, value - lag(value) OVER {_W} d FROM events) SELECT user_id, round(coalesce(sum(d) FILTER (d > 0), 0), 5) AS climb, round(coalesce(-sum(d) FILTER (d < 0), 0), 5) AS fall, round(coalesce(sum(d), 0), 5) AS net FROM d GROUP BY 1")(lambda t: rounded(fe.differences_along(_events(t), "value", ["user_id"], ORDER), 5))
query("probability_integral", "SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 - 0.5) / count(*) OVER (), 8) AS c_acctbal_pit FROM customer")(lambda t: rounded(fe.probability_integral(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal").drop("c_acctbal"), 8))
query("seasonal_trend")(lambda t: k.transformed(_events(t), "user_id", ORDER, "value", lambda x: k.seasonal_trend(x, 7)[0], "trend").select("event_id", "trend"))
query("break_in_unit_root")(lambda t: k.per_series(_events(t), "user_id", ORDER, "value", {"t": k.break_in_unit_root}))
query("seasonal_ar")(lambda t: k.transformed(_events(t), "user_id", ORDER, "value", k.seasonal_ar(7, 2, 1, 1), "forecast").select("event_id", "forecast"))
query("shapiro_wilk")(lambda t: k.per_series(_events(t), "user_id", ORDER, "value", {"w": lambda x: (k.shapiro_wilk(x) or (None, None))[0], "p": lambda x: (k.shapiro_wilk(x) or (None, None))[1]}))
query("skewness_corrected")(lambda t: fe.skewness_corrected(t("orders").withColumn("x", F.exp(F.col("o_totalprice") / 100000)), ["x"])[0].select("o_orderkey", F.round("x", 6).alias("x")))
query("independent_components")(lambda t: _pairs(t("part"), [(i, j, round(float(v), 5)) for i, row in enumerate(fe.independent_components(_parts(t), ["x", "y"], 2, rounds=8)[1]) for j, v in enumerate(row)], "i int, j int, v double"))
query("interactions_by_gain")(lambda t: _pairs(t("lineitem"), [(a, b, round(v, 6)) for a, b, v in fe.interactions_by_gain(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 3)], "a string, b string, r double"))
query("without_collinear")(lambda t: _pairs(t("lineitem"), [(x,) for x in fe.without_collinear(t("lineitem").withColumn("twice", F.col("l_quantity") * 2 + F.col("l_tax")), ["l_quantity", "l_tax", "twice", "l_discount"])], "name string"))

# Charts

query("chart_bars", "SELECT o_orderpriority, count(*) AS value FROM orders GROUP BY 1")(lambda t: ch.bars(t("orders"), "o_orderpriority", F.count("*")))
query("chart_grouped_bars", "SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 5) AS value FROM orders GROUP BY 1, 2")(lambda t: rounded(ch.bars(t("orders"), "o_orderpriority", F.avg("o_totalprice"), "o_orderstatus"), 5))
query("chart_line", "SELECT date_trunc('day', ts) AS at, count(*) AS value FROM events GROUP BY 1")(lambda t: ch.line(t("events"), "ts", "day", F.count("*")).select(F.col("at").cast("timestamp_ntz").alias("at"), "value"))
query("chart_band", "SELECT p_size AS x, count(*) AS n, round(avg(p_retailprice), 5) AS mean, round(avg(p_retailprice) - 1.959963984540054 * stddev_samp(p_retailprice) / sqrt(count(*)), 5) AS low, round(avg(p_retailprice) + 1.959963984540054 * stddev_samp(p_retailprice) / sqrt(count(*)), 5) AS high FROM part GROUP BY 1")(lambda t: rounded(ch.band(t("part"), F.col("p_size"), "p_retailprice"), 5))
query("chart_prediction_interval", "WITH e AS (SELECT avg(l_extendedprice - l_quantity * 1000) m, stddev_samp(l_extendedprice - l_quantity * 1000) s FROM lineitem) SELECT l_orderkey, l_linenumber, round(l_quantity * 1000 + m - 1.959963984540054 * s, 4) AS low, round(l_quantity * 1000 + m + 1.959963984540054 * s, 4) AS high FROM lineitem, e")(
    lambda t: rounded(ch.prediction_interval(t("lineitem").withColumn("p", F.col("l_quantity") * 1000.0), "l_extendedprice", "p").select("l_orderkey", "l_linenumber", "low", "high"), 4)
)
query("chart_members_interval", "WITH d AS (SELECT p_partkey, p_size * 1.0 a, p_size * 1.2 b, p_size * 0.7 c FROM part), m AS (SELECT *, (a + b + c) / 3 m FROM d), s AS (SELECT *, sqrt(((a - m) ** 2 + (b - m) ** 2 + (c - m) ** 2) / 2) s FROM m) SELECT p_partkey, round(m, 5) AS mean, round(m - 1.959963984540054 * s, 5) AS low, round(m + 1.959963984540054 * s, 5) AS high FROM s")(
    lambda t: rounded(ch.members_interval(t("part").select("p_partkey", *((F.col("p_size") * v).alias(n) for n, v in (("a", 1.0), ("b", 1.2), ("c", 0.7)))), ["a", "b", "c"]).drop("a", "b", "c"), 5)
)
query("chart_cluster_summary", "SELECT p_brand, count(*) AS n, round(avg(p_size), 5) AS mean_x, round(stddev_pop(p_size), 5) AS std_x FROM part GROUP BY 1")(lambda t: rounded(ch.cluster_summary(_parts(t), "p_brand", ["x"]), 5))
query("chart_network", "WITH e AS (SELECT c_nationkey src, (c_custkey * 7) % 25 dst, 1.0 w FROM customer), d AS (SELECT n, sum(w) w FROM (SELECT src n, w FROM e UNION ALL SELECT dst, w FROM e) GROUP BY 1), k AS (SELECT n FROM d ORDER BY w DESC, n LIMIT 6) SELECT src, dst, w FROM e WHERE src IN (FROM k) AND dst IN (FROM k)")(
    lambda t: ch.network(t("customer").select(F.col("c_nationkey").cast("long").alias("src"), (F.col("c_custkey") * 7 % 25).cast("long").alias("dst"), F.lit(1.0).alias("w")), 6)
)
for _name, _f in (
    ("chart_probability_points", lambda t: ch.probability_points(t("orders"), "o_totalprice", 20)),
    ("chart_strips", lambda t: ch.strips(t("part"), "p_brand", "p_retailprice", 12)),
    ("chart_raincloud", lambda t: ch.raincloud(t("part"), "p_brand", "p_retailprice", 12)),
    ("stemming", lambda t: tx.stemmed(t("documents").select("doc_id", "text"), "doc_id", tx.split_words(F.coalesce("text", F.lit("")))).select("doc_id", F.size("stems").alias("n"))),
    ("sentiment", lambda t: t("documents").select("doc_id", F.round(tx.polarity(tx.split_words(F.coalesce("text", F.lit(""))), {"the": 0.5, "and": -0.25, "good": 1.0}), 6).alias("polarity"))),
):
    query(_name)(lambda t, f=_f: f(t))

_TAGS = "CASE " + " ".join(f"WHEN lower(w) = '{w}' THEN '{tag}'" for w, tag in tx.CLOSED.items()) + " WHEN regexp_matches(w, '^[0-9][0-9.,]*$') THEN 'NUM' " + " ".join(f"WHEN lower(w) LIKE '%{e}' AND length(w) > {len(e) + 1} THEN '{tag}'" for e, tag in tx.ENDINGS) + " ELSE 'NOUN' END"
query("word_classes", f"SELECT w, {_TAGS} AS class FROM (SELECT DISTINCT unnest(string_split(p_type, ' ')) w FROM part UNION SELECT unnest(['the', 'running', 'quickly', '12.5', 'nation', 'red', 'IS', 'powerful']))")(
    lambda t: t("part").select(F.explode(F.split("p_type", " ")).alias("w")).union(t("part").limit(1).select(F.explode(F.array(*map(F.lit, ("the", "running", "quickly", "12.5", "nation", "red", "IS", "powerful")))))).distinct().select("w", tx.word_class(F.col("w")).alias("class"))
)
