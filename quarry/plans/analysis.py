"""Queries of statistics, metrics, features, models and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.special import chi2_sf, norm_cdf_sql, norm_ppf
from quarry.operators import features as fe
from quarry.operators import graph as g
from quarry.operators import metrics as m
from quarry.operators import models as mo
from quarry.operators import statistics as st
from quarry.plans.registry import query


def rounded(df, digits=6, *keep):
    """Doubles rounded, so that the order of sums does not show."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else c for c, t in df.dtypes))


def one_row(t, values: dict):
    return rounded(t.sparkSession.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values)))


_SUM = "SELECT '{c}' AS name, CAST(count({c}) AS DOUBLE) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem"


@query("summary", " UNION ALL ".join(_SUM.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _(t):
    return rounded(st.summary(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("moments_by_group", "WITH s AS (SELECT l_returnflag, avg(l_extendedprice) m, stddev_pop(l_extendedprice) s, count(*) n FROM lineitem GROUP BY 1), z AS (SELECT l_returnflag, n, m, s, avg(((l_extendedprice - m) / s) ** 3) m3, avg(((l_extendedprice - m) / s) ** 4) m4 FROM lineitem JOIN s USING (l_returnflag) GROUP BY 1, 2, 3, 4) SELECT l_returnflag, n, round(m, 6) AS mean, round(s, 6) AS std, round(m3 * n * n / ((n - 1) * (n - 2)), 6) AS skew, round(m4 - 3, 6) AS kurtosis FROM z")
def _(t):
    return rounded(st.moments(t("lineitem"), "l_extendedprice", ["l_returnflag"]))


@query("median_absolute_deviation", "WITH m AS (SELECT median(o_totalprice) m FROM orders) SELECT round(median(abs(o_totalprice - m)), 6) AS mad FROM orders, m")
def _(t):
    return one_row(t("orders"), {"mad": st.median_absolute_deviation(t("orders"), "o_totalprice")})


@query("rank_average", "SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rank FROM lineitem")
def _(t):
    return st.average_ranks(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").drop("l_quantity")


@query("pearson", "SELECT CAST(count(*) AS DOUBLE) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def _(t):
    found = st.pearson(t("lineitem"), "l_quantity", "l_extendedprice")
    return one_row(t("lineitem"), {k: found[k] for k in ("n", "r")})


@query("spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 b FROM lineitem) SELECT round(corr(a, b), 6) AS r FROM r")
def _(t):
    return one_row(t("lineitem"), {"r": st.spearman(t("lineitem"), "l_quantity", "l_discount")["r"]})


_T = "WITH s AS (SELECT avg(l_extendedprice) FILTER (l_returnflag = 'A') m1, var_samp(l_extendedprice) FILTER (l_returnflag = 'A') v1, count(*) FILTER (l_returnflag = 'A') n1, avg(l_extendedprice) FILTER (l_returnflag = 'R') m2, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') v2, count(*) FILTER (l_returnflag = 'R') n2 FROM lineitem) "


@query("welch_t", _T + "SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS df FROM s")
def _(t):
    f = st.two_sample_t(t("lineitem"), "l_extendedprice", "l_returnflag", "A", "R")
    return one_row(t("lineitem"), {"t": f["t"], "df": round(f["df"], 4)})


@query("student_t", _T + "SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t, CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM s")
def _(t):
    f = st.two_sample_t(t("lineitem"), "l_extendedprice", "l_returnflag", "A", "R", equal_var=True)
    return one_row(t("lineitem"), {"t": f["t"], "df": f["df"]})


@query("paired_t", "SELECT CAST(count(*) AS DOUBLE) AS n, round(avg(l_tax - l_discount) / (stddev_samp(l_tax - l_discount) / sqrt(count(*))), 6) AS t, round(avg(l_tax - l_discount) / stddev_samp(l_tax - l_discount), 6) AS d FROM lineitem")
def _(t):
    f = st.paired_t(t("lineitem"), "l_tax", "l_discount")
    return one_row(t("lineitem"), {k: f[k] for k in ("n", "t", "d")})


_KS = "WITH c AS (SELECT l_extendedprice v, count(*) FILTER (l_returnflag = 'A') a, count(*) FILTER (l_returnflag = 'R') b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1), d AS (SELECT a, b, abs(sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER ()) g FROM c) SELECT CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2, round(max(g), 6) AS d FROM d"


@query("kolmogorov_smirnov_two_sample", _KS)
def _(t):
    return rounded(st.ks_two_sample(t("lineitem").where("l_returnflag IN ('A', 'R')"), "l_extendedprice", F.col("l_returnflag") == "A"))


@query("chi_square_independence", "WITH c AS (SELECT l_returnflag r, l_linestatus s, count(*) o FROM lineitem GROUP BY ALL), x AS (SELECT r, s, coalesce(o, 0) o FROM (SELECT DISTINCT r FROM c) CROSS JOIN (SELECT DISTINCT s FROM c) LEFT JOIN c USING (r, s)), e AS (SELECT *, sum(o) OVER (PARTITION BY r) * sum(o) OVER (PARTITION BY s) / sum(o) OVER () e FROM x) SELECT CAST(sum(o) AS BIGINT) AS n, round(sum((o - e) ** 2 / e), 4) AS chi2, (count(DISTINCT r) - 1) * (count(DISTINCT s) - 1) AS df, round(sqrt(sum((o - e) ** 2 / e) / (sum((o - e) ** 2 / e) + sum(o))), 6) AS contingency FROM e")
def _(t):
    return st.chi_square_independence(t("lineitem"), "l_returnflag", "l_linestatus").select("n", F.round("chi2", 4).alias("chi2"), "df", F.round("contingency", 6).alias("contingency"))


@query("kruskal_wallis", "WITH r AS (SELECT o_orderpriority g, o_totalprice v, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 r FROM orders), t AS (SELECT sum(c * c * c - c) t FROM (SELECT CAST(count(*) AS HUGEINT) c FROM orders GROUP BY o_totalprice)), s AS (SELECT count(*) n, sum(r) r FROM r GROUP BY g) SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS k, round((12 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - max(t) / (CAST(sum(n) AS DOUBLE) ** 3 - sum(n))), 4) AS h FROM s, t")
def _(t):
    return st.kruskal_wallis(t("orders"), "o_totalprice", "o_orderpriority").select("n", "k", F.round("h", 4).alias("h"))


_D = "d AS (SELECT l_tax - l_discount d FROM lineitem WHERE l_tax - l_discount <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 r FROM d), t AS (SELECT sum(c * c * c - c) t FROM (SELECT CAST(count(*) AS HUGEINT) c FROM d GROUP BY abs(d)))"


@query("wilcoxon_signed_rank", f"WITH {_D}, s AS (SELECT count(*) n, sum(r) FILTER (d > 0) p, sum(r) FILTER (d < 0) q FROM r) SELECT n, p AS w_plus, q AS w_minus, round((p - n * (n + 1) / 4 - sign(p - n * (n + 1) / 4) * 0.5) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - t / 48), 6) AS z FROM s, t")
def _(t):
    return rounded(st.wilcoxon_signed_rank(t("lineitem"), "l_tax", "l_discount"))


_P = "greatest(least(" + norm_cdf_sql("((x - m) / s)") + ", 1 - 1e-12), 1e-12)"


@query("anderson_darling", f"WITH s AS (SELECT count(*) n, avg(o_totalprice) m, stddev_samp(o_totalprice) s FROM orders), v AS (SELECT o_totalprice x, count(*) c FROM orders GROUP BY 1), w AS (SELECT x, c, sum(c) OVER (ORDER BY x) hi FROM v), p AS (SELECT n, hi * hi - (hi - c) * (hi - c) up, c, {_P} p FROM w, s) SELECT n, round(-n - sum(up * ln(p) + (c * 2 * n - up) * ln(1 - p)) / n, 4) AS a2, round((-n - sum(up * ln(p) + (c * 2 * n - up) * ln(1 - p)) / n) * (1 + 0.75 / n + 2.25 / (n * n)), 4) AS a2_adjusted FROM p GROUP BY n")
def _(t):
    return rounded(st.anderson_darling_normal(t("orders"), "o_totalprice"), 4)


@query("sign_test", "SELECT count(*) AS n, count(*) FILTER (d > 0) AS positive, round(median(d), 6) AS median_difference FROM (SELECT l_tax - l_discount d FROM lineitem) WHERE d <> 0")
def _(t):
    return rounded(st.sign_test(t("lineitem"), "l_tax", "l_discount"))


@query("mean_interval", f"SELECT count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(avg(c_acctbal) - {norm_ppf(0.975)!r} * stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS low, round(avg(c_acctbal) + {norm_ppf(0.975)!r} * stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS high FROM customer")
def _(t):
    return rounded(st.mean_interval(t("customer"), "c_acctbal"))


@query("adjusted_p_values", "WITH p AS (SELECT p_partkey, p_partkey / 1e6 + 0.0001 AS p FROM part) SELECT p_partkey, round(least(1.0, min(p) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) * count(*) OVER () / row_number() OVER (ORDER BY p)), 8) AS adjusted FROM p")
def _(t):
    return rounded(st.adjusted_p_values(t("part").select("p_partkey", (F.col("p_partkey") / F.lit(1e6) + F.lit(0.0001)).alias("p")), "p").drop("p"), 8)


@query("normal_posterior", "WITH s AS (SELECT count(*) n, avg(c_acctbal) m FROM customer) SELECT n, round(1 / (1 / 100.0 + n / 2500.0) * (10 / 100.0 + n * m / 2500.0), 6) AS mean, round(1 / (1 / 100.0 + n / 2500.0), 6) AS variance FROM s")
def _(t):
    return rounded(st.normal_posterior(t("customer"), "c_acctbal", 10.0, 100.0, 2500.0))


@query("gaussian_bic", "SELECT count(*) AS n, round(count(*) * (ln(2 * pi() * var_pop(c_acctbal)) + 1) + 2 * ln(count(*)), 4) AS bic FROM customer")
def _(t):
    return rounded(st.gaussian_bic(t("customer"), "c_acctbal"), 4)


@query("entropy", "WITH c AS (SELECT count(*) c FROM orders GROUP BY o_orderpriority, o_orderstatus), p AS (SELECT c / sum(c) OVER () p FROM c) SELECT round(-sum(p * ln(p)) / ln(2), 6) AS entropy FROM p")
def _(t):
    return rounded(st.entropy(t("orders"), ["o_orderpriority", "o_orderstatus"]))


@query("conditional_entropy", "WITH c AS (SELECT l_returnflag x, l_linestatus y, count(*) c FROM lineitem GROUP BY ALL), p AS (SELECT c / sum(c) OVER () p, sum(c) OVER (PARTITION BY x) / sum(c) OVER () px, sum(c) OVER (PARTITION BY y) / sum(c) OVER () py FROM c) SELECT round(-sum(p * ln(p / px)) / ln(2), 6) AS conditional_entropy, round(sum(p * ln(p / (px * py))) / ln(2), 6) AS mutual_information FROM p")
def _(t):
    return rounded(st.conditional_entropy(t("lineitem"), "l_returnflag", "l_linestatus"))


COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("correlation_pairs", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(COLS) for b in COLS[i + 1 :]))
def _(t):
    return rounded(st.correlation_pairs(t("lineitem"), COLS))


@query("variance_inflation", "WITH r AS (SELECT corr(l_quantity, l_extendedprice) r FROM lineitem) SELECT unnest(['l_extendedprice', 'l_quantity']) AS name, round(1 / (1 - r * r), 6) AS vif FROM r")
def _(t):
    x = t("lineitem")
    return rounded(x.sparkSession.createDataFrame(st.variance_inflation(x, ["l_quantity", "l_extendedprice"]), "name string, vif double"))


@query("mahalanobis", "WITH s AS (SELECT avg(l_quantity) a, avg(l_discount) b, var_samp(l_quantity) v, var_samp(l_discount) w, covar_samp(l_quantity, l_discount) c FROM lineitem) SELECT l_orderkey, l_linenumber, round(sqrt((w * (l_quantity - a) ** 2 - 2 * c * (l_quantity - a) * (l_discount - b) + v * (l_discount - b) ** 2) / (v * w - c * c)), 5) AS distance FROM lineitem, s")
def _(t):
    return rounded(st.mahalanobis(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"]).drop("l_quantity", "l_discount"), 5)


# Metrics: y is the price, p a crude prediction from the quantity.
_YP = "(SELECT l_extendedprice y, l_quantity * 1000 + 1 p FROM lineitem)"


@query(
    "regression_metrics",
    f"""SELECT round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) ** 2), 2) AS mse, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(median(abs(y - p)), 4) AS median_ae, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
    round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_variance, round(avg((y - p) ** 2) / var_pop(y), 6) AS nmse, round(sqrt(avg((y - p) ** 2)) / (sqrt(avg(y * y)) + sqrt(avg(p * p))), 6) AS theil_u, round(avg(abs(y - p) / abs(y)), 6) AS mape, round(avg(2 * abs(y - p) / (abs(y) + abs(p))), 6) AS smape FROM {_YP}""",
)
def _(t):
    x = t("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000 + 1).alias("p"))
    digits = {"mse": 2, "mae": 4, "rmse": 4, "median_ae": 4}
    found = m.regression_scores(x, F.col("y"), F.col("p"))
    return found.select(*(F.round(k, digits.get(k, 6)).alias(k) for k in found.columns))


@query("deviances", f"SELECT round(2 * avg(y * ln(y / p) - y + p), 3) AS poisson, round(2 * avg(ln(p / y) + y / p - 1), 6) AS gamma, round(2 * avg(y ** 0.5 / (-0.5 * 0.5) - y * p ** -0.5 / -0.5 + p ** 0.5 / 0.5), 4) AS tweedie, round(avg((ln(y + 1e-8) - ln(p + 1e-8)) ** 2), 6) AS msle FROM {_YP}")
def _(t):
    x = t("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000 + 1).alias("p"))
    y, p = F.col("y"), F.col("p")
    return x.agg(F.round(m.tweedie_deviance(y, p, 1), 3).alias("poisson"), F.round(m.tweedie_deviance(y, p, 2), 6).alias("gamma"), F.round(m.tweedie_deviance(y, p, 1.5), 4).alias("tweedie"), F.round(m.log_error(y, p), 6).alias("msle"))


_BP = "(SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END y, least(greatest(l_quantity / 50, 0.01), 0.99) p FROM lineitem)"


@query("classification_losses", f"SELECT round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss, round(1 - (2 * sum(y * p) + 1) / (sum(y) + sum(p) + 1), 6) AS dice, round(1 - (sum(y * p) + 1) / (sum(y * p) + 0.3 * sum((1 - y) * p) + 0.7 * sum(y * (1 - p)) + 1), 6) AS tversky, round(avg(0.5 * (y * p * p + (1 - y) * greatest(1 - p, 0) ** 2)), 6) AS contrastive, round(avg(greatest(p - y + 0.2, 0)), 6) AS triplet FROM {_BP}")
def _(t):
    x = t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.least(F.greatest(F.col("l_quantity") / 50, F.lit(0.01)), F.lit(0.99)).alias("p"))
    y, p = F.col("y"), F.col("p")
    made = {"log_loss": m.cross_entropy(y, p), "dice": m.dice_loss(y, p), "tversky": m.tversky_loss(y, p, 0.3, 0.7), "contrastive": m.contrastive_loss(y, p, 1.0), "triplet": m.triplet_loss(p, y, 0.2)}
    return x.agg(*(F.round(e, 6).alias(k) for k, e in made.items()))


@query("roc_auc", f"WITH c AS (SELECT p, count(*) FILTER (y = 1) a, count(*) FILTER (y = 0) b FROM {_BP} GROUP BY 1), w AS (SELECT a, b, a * (coalesce(sum(b) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + b / 2) AS won FROM c) SELECT round(sum(won) / (sum(a) * sum(b)), 6) AS auc FROM w")
def _(t):
    x = t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.least(F.greatest(F.col("l_quantity") / 50, F.lit(0.01)), F.lit(0.99)).alias("p"))
    return rounded(m.roc_auc(x, "y", "p"))


@query("confusion", f"WITH c AS (SELECT count(*) FILTER (y = 1 AND p > 0.5) AS tp, count(*) FILTER (y = 0 AND p > 0.5) AS fp, count(*) FILTER (y = 1 AND p <= 0.5) AS fn, count(*) FILTER (y = 0 AND p <= 0.5) AS tn FROM {_BP}) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def _(t):
    x = t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50 > 0.5).cast("int").alias("p"))
    return rounded(m.confusion(x, "y", "p"))


_HAV = "2 * 6371 * atan2(sqrt({a}), sqrt(1 - {a}))"
_A = "(pow(sin((b.lat - a.lat) * pi() / 360), 2) + cos(a.lat * pi() / 180) * cos(b.lat * pi() / 180) * pow(sin((b.lon - a.lon) * pi() / 360), 2))"


def _places(t):
    k = F.col("n_nationkey")
    return t("nation").select(k.alias("k"), (k * 7 % 180 - 90).cast("double").alias("lat"), (k * 13 % 360 - 180).cast("double").alias("lon"))


_PLACES = "p AS (SELECT n_nationkey k, CAST(n_nationkey * 7 % 180 - 90 AS DOUBLE) lat, CAST(n_nationkey * 13 % 360 - 180 AS DOUBLE) lon FROM nation)"


@query("haversine", f"WITH {_PLACES} SELECT a.k AS a, b.k AS b, round({_HAV.format(a=_A)}, 4) AS km FROM p a JOIN p b ON b.k = a.k + 1")
def _(t):
    p = _places(t)
    a, b = p.alias("a"), p.alias("b")
    return a.join(b, F.col("b.k") == F.col("a.k") + 1).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.round(m.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), 4).alias("km"))


@query("geohash")
def _(t):
    return _places(t).select("k", fe.geohash(F.col("lat"), F.col("lon"), 7).alias("geohash"))


# Features


@query("polynomial_features", "SELECT p_partkey, CAST(p_size * p_size AS BIGINT) AS p_size_x_p_size, round(p_size * p_retailprice, 4) AS p_size_x_p_retailprice, round(p_retailprice * p_retailprice, 4) AS p_retailprice_x_p_retailprice FROM part")
def _(t):
    d = fe.polynomial(t("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 2).drop("p_size", "p_retailprice")
    return rounded(d.withColumn("p_size_x_p_size", F.col("p_size_x_p_size").cast("long")), 4)


@query("ratio_features", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax <> 0 THEN l_discount / l_tax ELSE -1 END, 6) AS l_discount_per_l_tax, round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount ELSE -1 END, 6) AS l_tax_per_l_discount FROM lineitem")
def _(t):
    return rounded(fe.ratios(t("lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"], -1.0).drop("l_discount", "l_tax"))


@query("rbf_features", "SELECT p_partkey, round(exp(-0.01 * (p_size - 10) ** 2), 6) AS p_size_rbf0, round(exp(-0.01 * (p_size - 40) ** 2), 6) AS p_size_rbf1 FROM part")
def _(t):
    return rounded(fe.rbf(t("part").select("p_partkey", "p_size"), "p_size", [10, 40], 0.01).drop("p_size"))


def _by_class(expr: str, name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS name, round({expr}, 6) AS {name} FROM (SELECT count(*) n, avg({c}) m, var_pop({c}) v, sum({c}) s, sum({c} * {c}) q, (SELECT avg({c}) FROM lineitem) g, (SELECT count(*) FROM lineitem) tn, (SELECT sum({c}) FROM lineitem) ts FROM lineitem GROUP BY l_returnflag)" for c in COLS)


query("fisher_scores", _by_class("sum(n * (m - g) ** 2) / (sum(n * v) + 1e-12)", "score"))(lambda t: rounded(fe.fisher_scores(t("lineitem"), COLS, "l_returnflag")))
query("anova_f", _by_class("((sum(s * s / n) - sum(s) ** 2 / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*)))", "f"))(lambda t: rounded(fe.anova_f(t("lineitem"), COLS, "l_returnflag")))
query("chi2_scores", _by_class("sum((s - n / tn * ts) ** 2 / (n / tn * ts))", "chi2"))(lambda t: rounded(fe.chi2_scores(t("lineitem"), COLS, "l_returnflag")))
query("variance_selector", " UNION ALL ".join(f"SELECT '{c}' AS name, round(var_pop({c}), 4) AS variance FROM lineitem" for c in COLS))(lambda t: rounded(fe.variances(t("lineitem"), COLS), 4))


@query("correlation_selector", "SELECT name FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS name) WHERE name <> 'l_extendedprice' OR (SELECT abs(corr(l_quantity, l_extendedprice)) FROM lineitem) <= 0.5")
def _(t):
    x = t("lineitem")
    return x.sparkSession.createDataFrame([(c,) for c in fe.uncorrelated(x, COLS, 0.5)], "name string")


@query("min_redundancy_selector")
def _(t):
    x = t("lineitem")
    return x.sparkSession.createDataFrame([(i, c) for i, c in enumerate(fe.min_redundancy(x, COLS, "l_returnflag", 3))], "place int, name string")


@query("undersample", "WITH s AS (SELECT min(c) m FROM (SELECT count(*) c FROM orders GROUP BY o_orderstatus)) SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':0'), 1, 15) AS BIGINT), o_orderkey) n FROM orders), s WHERE n <= m")
def _(t):
    return fe.undersampled(t("orders"), "o_orderkey", "o_orderstatus").select("o_orderkey", "o_orderstatus")


@query("oversample", "WITH a AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':0'), 1, 15) AS BIGINT), o_orderkey) p, count(*) OVER (PARTITION BY o_orderstatus) c FROM orders), b AS (SELECT *, max(c) OVER () m FROM a) SELECT o_orderkey, o_orderstatus, unnest(range(m // c + CASE WHEN p <= m % c THEN 1 ELSE 0 END)) AS copy FROM b")
def _(t):
    return fe.oversampled(t("orders"), "o_orderkey", "o_orderstatus").select("o_orderkey", "o_orderstatus", "copy")


@query("child_aggregates", "SELECT c_custkey, n_children, round(s, 8) AS sum_o_totalprice, round(a, 8) AS mean_o_totalprice, lo AS min_o_totalprice, hi AS max_o_totalprice, round(d, 4) AS std_o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, count(*) n_children, sum(o_totalprice) s, avg(o_totalprice) a, min(o_totalprice) lo, max(o_totalprice) hi, stddev_pop(o_totalprice) d FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(t):
    x = fe.aggregates_of_children(t("customer").select("c_custkey"), t("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["o_totalprice"])
    return rounded(x.withColumn("std_o_totalprice", F.round("std_o_totalprice", 4)), 8)


# Models


@query("linear_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def _(t):
    x = t("lineitem")
    f = mo.fit_linear(x, ["l_quantity"], "l_extendedprice")
    return x.sparkSession.createDataFrame([(round(f.weights[0], 4), round(f.intercept, 3))], "slope double, intercept double")


@query("linear_prediction", "WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) a, regr_intercept(l_extendedprice, l_quantity) b FROM lineitem) SELECT l_orderkey, l_linenumber, round(a * l_quantity + b, 3) AS prediction FROM lineitem, f")
def _(t):
    x = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(mo.fit_linear(x, ["l_quantity"], "l_extendedprice").predict(x).select("l_orderkey", "l_linenumber", "prediction"), 3)


@query("ridge_regression", "WITH s AS (SELECT covar_samp(l_quantity, l_extendedprice) * (count(*) - 1) / (var_samp(l_quantity) * (count(*) - 1) + 1000) w, avg(l_quantity) a, avg(l_extendedprice) b FROM lineitem) SELECT round(w, 4) AS slope, round(b - w * a, 3) AS intercept FROM s")
def _(t):
    x = t("lineitem")
    f = mo.fit_linear(x, ["l_quantity"], "l_extendedprice", ridge=1000)
    return x.sparkSession.createDataFrame([(round(f.weights[0], 4), round(f.intercept, 3))], "slope double, intercept double")


@query("principal_components")
def _(t):
    x = t("lineitem")
    v, _vectors = mo.principal_components(x, ["l_quantity", "l_discount", "l_tax"], 2)
    return x.sparkSession.createDataFrame([(i, float(a)) for i, a in enumerate(v)], "component int, variance double")


@query("discriminant_directions")
def _(t):
    x = t("lineitem")
    v, _vectors = mo.fit_discriminant(x, ["l_quantity", "l_discount", "l_tax"], "l_returnflag", 2)
    return x.sparkSession.createDataFrame([(i, float(a)) for i, a in enumerate(v)], "component int, ratio double")


def _ml(kind, target, **params):
    def run(t):
        x = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("double").alias("label"), F.col("l_extendedprice").alias("price"))
        model = mo.fit_ml(x, kind, ["l_quantity", "l_discount", "l_tax"], target, **params)
        return model.transform(mo.assembled(x, ["l_quantity", "l_discount", "l_tax"])).select("l_orderkey", "l_linenumber", F.col("prediction").cast("double"))

    return run


for _kind, _target, _params in (
    ("logistic", "label", {"maxIter": 10}), ("tree", "label", {"maxDepth": 4}), ("forest", "label", {"numTrees": 5, "maxDepth": 4, "seed": 1}), ("boosted", "label", {"maxIter": 3, "maxDepth": 3, "seed": 1}), ("svm", "label", {"maxIter": 5}), ("naive_bayes", "label", {}),
    ("mlp", "label", {"layers": [3, 4, 2], "maxIter": 5, "seed": 1}), ("tree_regressor", "price", {"maxDepth": 4}), ("forest_regressor", "price", {"numTrees": 5, "seed": 1}), ("boosted_regressor", "price", {"maxIter": 3, "seed": 1}), ("elastic_net", "price", {"regParam": 0.1, "elasticNetParam": 0.5}), ("glm", "price", {}),
    ("k_means", None, {"k": 4, "seed": 1}), ("bisecting", None, {"k": 4, "seed": 1}), ("mixture", None, {"k": 3, "seed": 1, "maxIter": 5}),
):
    query(f"model_{_kind}")(_ml(_kind, _target, **_params))


# Graphs: an edge for each pair of nations of a customer and a supplier of one of their orders, weighted by how many.


def _edges(t):
    e = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return e.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("w"))


_E = "e AS (SELECT c_nationkey src, s_nationkey dst, count(*) w FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"


@query(
    "pagerank",
    f"""WITH RECURSIVE {_E}, s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) p FROM e), n AS (SELECT src node FROM e UNION SELECT dst FROM e), c AS (SELECT count(*) c FROM n),
    r(i, node, rank) AS (SELECT 0, node, 1.0::DOUBLE / c FROM n, c UNION ALL
      (SELECT l.i + 1, n.node, 0.15::DOUBLE / any_value(c.c) + 0.85 * (coalesce(sum(x.rank * s.p), 0) + any_value(l.lost) / any_value(c.c)) FROM n CROSS JOIN c CROSS JOIN (SELECT max(i) i, coalesce(sum(rank) FILTER (node NOT IN (SELECT src FROM e)), 0) lost FROM r) l LEFT JOIN s ON s.dst = n.node LEFT JOIN r x ON x.node = s.src WHERE l.i < 6 GROUP BY l.i, n.node))
    SELECT node, round(rank, 8) AS rank FROM r WHERE i = 6""",
)
def _(t):
    return rounded(g.pagerank(_edges(t), rounds=6), 8)


@query("shortest_paths")
def _(t):
    return g.shortest_paths(_edges(t), 0)


@query("breadth_first", f"WITH {_E} SELECT node, round(min(d), 1) AS distance FROM (SELECT 0 AS node, 0.0::DOUBLE AS d UNION ALL SELECT dst, 1.0 FROM e WHERE src = 0 UNION ALL SELECT b.dst, 2.0 FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 0) GROUP BY 1")
def _(t):
    return g.bfs(_edges(t), 0)


@query("degrees", f"WITH {_E}, o AS (SELECT src node, count(*) out_degree, CAST(sum(w) AS BIGINT) out_weight FROM e GROUP BY 1), i AS (SELECT dst node, count(*) in_degree, CAST(sum(w) AS BIGINT) in_weight FROM e GROUP BY 1) SELECT node, coalesce(out_degree, 0) AS out_degree, coalesce(out_weight, 0) AS out_weight, coalesce(in_degree, 0) AS in_degree, coalesce(in_weight, 0) AS in_weight FROM o FULL JOIN i USING (node)")
def _(t):
    return g.degrees(_edges(t))


_X = "x AS (SELECT c_nationkey node, avg(c_acctbal) x FROM customer GROUP BY 1)"


@query("morans_i", f"WITH {_E}, {_X}, s AS (SELECT count(*) n, avg(x) m FROM x), v AS (SELECT sum((x - m) ** 2) v FROM x, s) SELECT any_value(n) AS n, round(any_value(n) / sum(w) * sum(w * (a.x - m) * (b.x - m)) / any_value(v), 6) AS i FROM e JOIN x a ON a.node = src JOIN x b ON b.node = dst, s, v")
def _(t):
    return rounded(g.morans_i(t("customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.avg("c_acctbal").alias("x")), _edges(t)))


@query("gearys_c", f"WITH {_E}, {_X}, s AS (SELECT count(*) n, var_samp(x) v FROM x) SELECT any_value(n) AS n, round(sum(w * (a.x - b.x) ** 2) / (2 * sum(w) * any_value(v)), 6) AS c FROM e JOIN x a ON a.node = src JOIN x b ON b.node = dst, s")
def _(t):
    return rounded(g.gearys_c(t("customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.avg("c_acctbal").alias("x")), _edges(t)))


@query("chi_square_p_value")
def _(t):
    x = t("lineitem")
    f = st.chi_square_independence(x, "l_returnflag", "l_linestatus").first()
    return x.sparkSession.createDataFrame([(float(f["chi2"]), chi2_sf(f["chi2"], f["df"]))], "chi2 double, p double")
