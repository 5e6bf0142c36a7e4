"""Queries of selection by information, imputation by models, medoids, kernels, factors, topics and checks of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import cleaning, clusters, control, drift, imputers, kernels, matrices, models, optimizers, regressors, scaling, selection
from quarry.operators import text as tx
from quarry.plans.analysis import rounded
from quarry.plans.learned import _START, _events, _pairs, _parts
from quarry.plans.registry import query

_LINE = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"]


def _coded(t):
    return t("lineitem").withColumn("many", F.floor(F.col("l_quantity") / 13).cast("int"))


def _information_sql(c: str) -> str:
    return f"SELECT '{c}' AS name, round(sum(n / t * log2(n * t / (a * b))), 8) AS bits FROM (SELECT n, CAST(sum(n) OVER () AS DOUBLE) t, CAST(sum(n) OVER (PARTITION BY x) AS DOUBLE) a, CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) b FROM (SELECT {c} x, floor(l_quantity / 13) y, count(*) n FROM lineitem GROUP BY 1, 2))"


query("mutual_information", " UNION ALL ".join(map(_information_sql, _LINE)))(lambda t: _pairs(t("lineitem"), [(c, round(v, 8)) for c, v in selection.mutual_information(_coded(t), _LINE, "many")], "name string, bits double"))
query("csv_faults", """WITH l AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a,"b,c",d' WHEN 1 THEN 'a,b' WHEN 2 THEN 'a,"b,c' ELSE c_custkey || ',x,' END l FROM customer), b AS (SELECT c_custkey, regexp_replace(l, '"[^"]*"', '', 'g') b FROM l), n AS (SELECT c_custkey, b, length(b) - length(replace(b, ',', '')) + 1 n FROM b) SELECT c_custkey, CAST(n AS INTEGER) AS n_fields, CASE WHEN b LIKE '%"%' THEN 'quotes' WHEN n <> 3 THEN 'fields' END AS fault FROM n""")(
    lambda t: cleaning.csv_faults(t("customer").select("c_custkey", F.expr("""CASE c_custkey % 4 WHEN 0 THEN 'a,"b,c",d' WHEN 1 THEN 'a,b' WHEN 2 THEN 'a,"b,c' ELSE concat(c_custkey, ',x,') END""").alias("l")), "l", 3).drop("l")
)
query("merged_moments", "SELECT 'x' AS name, round(avg(p_size), 6) AS mean, round(var_samp(p_size), 5) AS variance FROM part UNION ALL SELECT 'y', round(avg(p_retailprice / 100), 6), round(var_samp(p_retailprice / 100), 5) FROM part")(
    lambda t: _pairs(t("part"), [(n, round(m.mean[i], 6), round(m.products[i][i] / (m.n - 1), 5)) for m in [sum((models.Moments.of(_parts(t).where(F.col("p_partkey") % 3 == i), ["x", "y"]) for i in (1, 2)), models.Moments.of(_parts(t).where("p_partkey % 3 = 0"), ["x", "y"]))] for i, n in enumerate(("x", "y"))], "name string, mean double, variance double")
)
query("scale_adaptive", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")(lambda t: rounded(scaling.fit_adaptive(t("customer"), ["c_acctbal"])[0].transform(t("customer").select("c_custkey", "c_acctbal"))))


def _gaps(t):
    return _parts(t).select("p_partkey", "x", "y", F.when(F.col("p_partkey") % 7 != 0, F.col("x") * 2 + F.col("y")).alias("v"))


def _means(t, centres):
    return _pairs(t("part"), [(i, round(a, 6), round(b, 6)) for i, (a, b) in enumerate(centres.points)], "cluster int, x double, y double")


_PRICE = lambda d: F.col("l_quantity") * 900.0 + F.col("l_tax") * 10
for _name, _f in (
    ("choice_cmim", lambda t: _pairs(t("lineitem"), list(enumerate(selection.by_information(_coded(t), _LINE, "many", 3))), "place int, name string")),
    ("choice_icap", lambda t: _pairs(t("lineitem"), list(enumerate(selection.by_information(_coded(t), _LINE, "many", 3, "icap"))), "place int, name string")),
    ("eliminated_cv", lambda t: _pairs(t("lineitem"), [(n, round(s, 6)) for n, s in selection.eliminated_cv(t("lineitem").withColumn("i", F.col("l_orderkey") * 8 + F.col("l_linenumber")), "i", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")[1]], "n int, r2 double")),
    ("automatic_selection", lambda t: _pairs(t("lineitem"), [(c,) for c in selection.automatic(t("lineitem"), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], "l_returnflag", 2)], "name string")),
    ("multiple_imputation", lambda t: _pairs(t("part"), [(i, round(d.agg(F.avg("v")).first()[0], 6)) for i, d in enumerate(imputers.multiple(_gaps(t), "p_partkey", ["x", "y", "v"], 3))], "draw int, mean double")),
    ("tree_imputation", lambda t: imputers.by_trees(_gaps(t), ["x", "y", "v"], rounds=1, trees=4)),
    ("medoids", lambda t: _means(t, clusters.medoids(_parts(t), "p_partkey", ["x", "y"], 3, 6, 4))),
    ("genetic_means", lambda t: _means(t, clusters.genetic_means(_parts(t), "p_partkey", ["x", "y"], 3, 4, 2))),
    ("consensus", lambda t: clusters.consensus(_parts(t), [clusters.Centres(("x", "y"), _START), clusters.Centres(("x", "y"), _START[:2])])),
    ("quick_shift", lambda t: clusters.quick_shift(_parts(t), "p_partkey", "x", "y", 1.5)),
    ("reset_test", lambda t: _pairs(t("lineitem"), [tuple(float(v) for v in models.reset_test(t("lineitem"), ["l_quantity"], "l_extendedprice").values())], "n double, f double, p double")),
    ("accumulated_effects", lambda t: models.accumulated_effects(t("lineitem"), "l_quantity", _PRICE, 8)),
    ("factor_loadings", lambda t: _pairs(t("lineitem"), [(i, j, round(float(v), 5)) for i, row in enumerate(models.factor_loadings(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 1)[0]) for j, v in enumerate(row)], "i int, j int, v double")),
    ("kernel_components", lambda t: models.kernel_components(_parts(t), "p_partkey", ["x", "y"], 2, gamma=0.01).select("p_partkey", F.round("pc0", 5).alias("pc0"), F.round("pc1", 5).alias("pc1"))),
    ("robustness", lambda t: _pairs(t("lineitem"), [(s, round(v, 6)) for s, v in control.robustness(t("lineitem").withColumn("i", F.col("l_orderkey") * 8 + F.col("l_linenumber")), "i", ["l_quantity"], lambda d: d.agg(F.corr("l_quantity", "l_extendedprice")).first()[0])], "size double, score double")),
    ("limited_memory_minimum", lambda t: _pairs(t("lineitem"), [(round(float(optimizers.lbfgs(optimizers.distributed(t("lineitem"), lambda p: F.pow(F.col("l_extendedprice") / 1000 - p[0] - p[1] * F.col("l_quantity"), 2)), [0.0, 0.0], rounds=8, tolerance=1e-4)[1]), 2),)], "slope double")),
    ("time_warped", lambda t: kernels.transformed(_events(t), "user_id", ["ts", "event_id"], "value", kernels.time_warped(), "warped").select("event_id", "warped")),
    ("jittered", lambda t: kernels.transformed(_events(t), "user_id", ["ts", "event_id"], "value", kernels.jittered(), "noisy").select("event_id", "noisy")),
    ("synthetic_quality", lambda t: drift.synthetic_quality(t("lineitem"), t("lineitem").withColumn("l_quantity", F.col("l_quantity") * 1.1), ["l_quantity", "l_extendedprice"])),
    ("stationarity", lambda t: drift.stationarity(t("events"), "value", ["user_id"], ["ts", "event_id"])),
    ("top_eigen", lambda t: _pairs(t("nation"), [(i, round(v, 5)) for i, (v, _) in enumerate(matrices.top_eigen(t("nation").select(F.col("n_nationkey").alias("i")).join(t("nation").select(F.col("n_nationkey").alias("j")), F.abs(F.col("i") - F.col("j")) <= 2).select("i", "j", (1.0 / (1 + F.abs(F.col("i") - F.col("j")))).alias("v")), 2, 12))], "place int, value double")),
    ("non_negative_factors", lambda t: matrices.non_negative_factors(t("lineitem").groupBy((F.col("l_suppkey") % 50).alias("i"), (F.col("l_partkey") % 40).alias("j")).agg(F.sum("l_quantity").alias("v")), 3, rounds=3)[0].select("id", F.size("features").alias("n"))),
    ("topics", lambda t: tx.topics(t("documents"), "doc_id", tx.split_words(F.coalesce("text", F.lit(""))), 3, 500, rounds=2)[1].select("doc_id", F.size(F.expr("transform(array(0), i -> i)")).alias("n"))),
):
    query(_name)(lambda t, f=_f: f(t))
