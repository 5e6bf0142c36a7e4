"""Queries of scalers, encoders and binning."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import binning as b
from quarry.operators import encoding as e
from quarry.operators import scaling as s
from quarry.plans.registry import query
from quarry.plans.relational import h


def _scaled(t, fit, **kw):
    c = t("customer").select("c_custkey", "c_acctbal")
    return fit(c, ["c_acctbal"], **kw).transform(c).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


def _sql(x: str) -> str:
    return f"SELECT c_custkey, round({x}, 6) AS c_acctbal FROM customer"


query("scale_standard", _sql("(c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ()"))(lambda t: _scaled(t, s.fit_standard))
query("scale_min_max", _sql("(c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) * 3 - 1"))(lambda t: _scaled(t, s.fit_min_max, low=-1.0, high=2.0))
query("scale_max_abs", _sql("c_acctbal / greatest(abs(min(c_acctbal) OVER ()), abs(max(c_acctbal) OVER ()))"))(lambda t: _scaled(t, s.fit_max_abs))
query("scale_robust", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.5) m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) k FROM customer) SELECT c_custkey, round((c_acctbal - m) / k, 6) AS c_acctbal FROM customer, q")(lambda t: _scaled(t, s.fit_robust))
query("scale_pareto", _sql("(c_acctbal - avg(c_acctbal) OVER ()) / sqrt(var_pop(c_acctbal) OVER ())"))(lambda t: _scaled(t, s.fit_pareto))


@query("scale_inverse", "SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal FROM customer")
def _(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    m = s.fit_standard(c, ["c_acctbal"])
    return m.inverse(m.transform(c)).select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


@query("outliers_z", "SELECT l_orderkey, l_linenumber, abs(l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () > 1.6 AS is_outlier FROM lineitem")
def _(t):
    return s.z_outliers(t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 1.6).drop("l_extendedprice")


@query("outliers_modified_z", "WITH m AS (SELECT median(l_extendedprice) m FROM lineitem), d AS (SELECT median(abs(l_extendedprice - m)) d FROM lineitem, m) SELECT l_orderkey, l_linenumber, abs(0.6745 * (l_extendedprice - m) / d) > 1.3 AS is_outlier FROM lineitem, m, d")
def _(t):
    return s.z_outliers(t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 1.3, modified=True).drop("l_extendedprice")


@query("outliers_iqr", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) a, quantile_cont(o_totalprice, 0.75) b FROM orders) SELECT o_orderkey, o_totalprice < a - 0.4 * (b - a) OR o_totalprice > b + 0.4 * (b - a) AS is_outlier FROM orders, q")
def _(t):
    return s.iqr_outliers(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.4).drop("o_totalprice")


@query("power_transforms", "SELECT c_custkey, round(sign(c_acctbal) * abs(c_acctbal) ** 0.5, 6) AS root, round(asinh(c_acctbal), 6) AS asinh, round(CASE WHEN c_acctbal > 0 THEN (c_acctbal ** 0.5 - 1) / 0.5 END, 6) AS box_cox, round(CASE WHEN c_acctbal >= 0 THEN ((c_acctbal + 1) ** 0.5 - 1) / 0.5 ELSE -((1 - c_acctbal) ** 1.5 - 1) / 1.5 END, 6) AS yeo_johnson, round(CASE WHEN c_acctbal + 1000 > 0 THEN log2(c_acctbal + 1000) END, 6) AS log2 FROM customer")
def _(t):
    x = F.col("c_acctbal")
    return t("customer").select("c_custkey", *(F.round(v, 6).alias(k) for k, v in {"root": s.power(x, 0.5), "asinh": F.asinh(x), "box_cox": s.box_cox(x, 0.5), "yeo_johnson": s.yeo_johnson(x, 0.5), "log2": s.log_scaled(x, 2.0, 1000.0)}.items()))


@query("yeo_johnson_fit")
def _(t):
    o = t("orders")
    return o.sparkSession.createDataFrame([(s.fit_lambda(o, "o_totalprice"),)], "lambda double")


@query("row_norms", "SELECT p_partkey, round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS p_size, round(p_retailprice / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS p_retailprice FROM part")
def _(t):
    return s.row_normalised(t("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]).select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


# Encoders


@query("encode_label", "SELECT p_partkey, CAST(i AS INTEGER) AS label FROM part JOIN (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT p_brand FROM part)) USING (p_brand)")
def _(t):
    p = t("part").select("p_partkey", "p_brand")
    return e.encode_labels(p, "p_brand", e.label_table(p, "p_brand")).select("p_partkey", "label")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("encode_one_hot", "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{v}' AS INTEGER) AS \"c_mktsegment_{v}\"" for v in SEGMENTS[1:]) + " FROM customer")
def _(t):
    return e.one_hot(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS, drop_first=True).drop("c_mktsegment")


@query("encode_effect", "SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{SEGMENTS[-1]}' THEN -1 WHEN c_mktsegment = '{v}' THEN 1 ELSE 0 END AS \"c_mktsegment_{v}\"" for v in SEGMENTS[:-1]) + " FROM customer")
def _(t):
    return e.effect_coded(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS).drop("c_mktsegment")


def _case(column: int) -> str:
    m = e.helmert_matrix(len(SEGMENTS))
    return "CASE c_mktsegment " + " ".join(f"WHEN '{v}' THEN {m[i][column]!r}" for i, v in enumerate(SEGMENTS)) + " ELSE 0.0 END"


@query("encode_helmert", "SELECT c_custkey, " + ", ".join(f"round(CAST({_case(j)} AS DOUBLE), 6) AS c_mktsegment_h{j}" for j in range(len(SEGMENTS) - 1)) + " FROM customer")
def _(t):
    d = e.helmert_coded(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS).drop("c_mktsegment")
    return d.select("c_custkey", *(F.round(c, 6).alias(c) for c in d.columns[1:]))


@query("encode_thermometer", "SELECT p_partkey, " + ", ".join(f"CAST(p_size > {v} AND p_size <= 5 AS INTEGER) AS p_size_t{v - 1}" for v in range(1, 5)) + " FROM part")
def _(t):
    return e.thermometer(t("part").select("p_partkey", "p_size"), "p_size", [1, 2, 3, 4, 5]).drop("p_size")


@query("encode_binary", "SELECT p_partkey, " + ", ".join(f"CAST((i >> {4 - k}) & 1 AS INTEGER) AS p_brand_b{k}" for k in range(5)) + " FROM part JOIN (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT p_brand FROM part)) USING (p_brand)")
def _(t):
    p = t("part").select("p_partkey", "p_brand")
    return e.binary_coded(p, "p_brand", e.label_table(p, "p_brand"), 5).drop("p_brand")


@query("encode_frequency", "SELECT o_orderkey, round(count(*) OVER (PARTITION BY o_orderpriority) / count(*) OVER (), 8) AS share FROM orders")
def _(t):
    o = t("orders").select("o_orderkey", "o_orderpriority")
    return e.joined_value(o, "o_orderpriority", e.frequency_table(o, "o_orderpriority"), "share", 0.0, "share").select("o_orderkey", F.round("share", 8).alias("share"))


@query("encode_rare", "SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_nationkey) >= 0.04 * count(*) OVER () THEN CAST(c_nationkey AS VARCHAR) ELSE 'Other' END AS c_nationkey FROM customer")
def _(t):
    return e.rare_merged(t("customer").select("c_custkey", "c_nationkey"), "c_nationkey", 0.04)


Y = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"


def _target(t, make, value="value"):
    x = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 40).alias("g"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    table = make(e.target_table(x, "g", "y"), e.overall(x, "y"))
    return e.joined_value(x, "g", table, value, 0.0, "encoded").select("l_orderkey", "l_linenumber", F.round("encoded", 8).alias("encoded"))


def _target_sql(x: str) -> str:
    return f"WITH b AS (SELECT l_orderkey, l_linenumber, l_suppkey % 40 AS g, {Y} AS y FROM lineitem), a AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, avg(y) OVER (PARTITION BY g) AS m, avg(y) OVER () AS p, sum(y) OVER (PARTITION BY g) AS s, sum(y) OVER () AS ts, count(*) OVER () AS tn FROM b) SELECT l_orderkey, l_linenumber, round({x}, 8) AS encoded FROM a"


query("encode_target", _target_sql("(n * m + 10 * p) / (n + 10)"))(lambda t: _target(t, lambda x, o: e.smoothed_means(x, o[1], 10)))
query("encode_catboost", _target_sql("(n * m + p) / (n + 1)"))(lambda t: _target(t, lambda x, o: e.ordered_prior_means(x, o[1])))
query("encode_glmm", _target_sql("CASE WHEN n < 2 THEN 0 ELSE n / (n + 5) * (m - p) END"))(lambda t: _target(t, lambda x, o: e.shrunken_effects(x, o[1], 5)))
query("encode_woe", _target_sql("ln((n - s + 0.5) / (tn - ts + 0.5)) - ln((s + 0.5) / (ts + 0.5))"))(lambda t: _target(t, lambda x, o: e.evidence_weights(x)))


@query("encode_target_median", "SELECT o_orderkey, round(median(o_totalprice) OVER (PARTITION BY o_orderpriority), 6) AS encoded FROM orders")
def _(t):
    o = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    table = e.median_values(e.target_table(o, "o_orderpriority", "o_totalprice"), e.overall(o, "o_totalprice")[2], 2)
    return e.joined_value(o, "o_orderpriority", table, "value", 0.0, "encoded").select("o_orderkey", F.round("encoded", 6).alias("encoded"))


@query(
    "encode_target_folds",
    f"""WITH b AS (SELECT o_orderkey, o_orderpriority AS g, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y, {h("o_orderkey")} % 5 AS f FROM orders)
    SELECT o_orderkey, round((sum(y) OVER (PARTITION BY g) - sum(y) OVER (PARTITION BY g, f) + 10 * (sum(y) OVER () - sum(y) OVER (PARTITION BY f)) / (count(*) OVER () - count(*) OVER (PARTITION BY f))) / (count(*) OVER (PARTITION BY g) - count(*) OVER (PARTITION BY g, f) + 10), 8) AS encoded FROM b""",
)
def _(t):
    o = t("orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return e.out_of_fold_means(o, "o_orderkey", "o_orderpriority", "y", 5, 10.0).select("o_orderkey", F.round("encoded", 8).alias("encoded"))


@query("encode_hash", "SELECT p_partkey, CAST(CAST('0x' || substr(md5(p_type), 1, 15) AS BIGINT) % 16 AS INTEGER) AS bucket FROM part")
def _(t):
    return t("part").select("p_partkey", e.hashed(F.col("p_type"), 16).alias("bucket"))


@query("encode_cyclic", "SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS h_sin1, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS h_cos1, round(sin(4 * pi() * hour(ts) / 24), 6) + 0.0 AS h_sin2, round(cos(4 * pi() * hour(ts) / 24), 6) + 0.0 AS h_cos2 FROM events")
def _(t):
    d = e.cyclic(t("events").select("event_id", F.hour("ts").alias("h")), "h", 24, 2).drop("h")
    return d.select("event_id", *((F.round(c, 6) + 0.0).alias(c) for c in d.columns[1:]))


# Bins


@query("bin_equal_width", "WITH m AS (SELECT min(o_totalprice) a, max(o_totalprice) b FROM orders) SELECT o_orderkey, CAST(least(greatest(list_sum(list_transform(range(1, 8), lambda i: CAST(o_totalprice >= a + (b - a) * i / 8 AS INTEGER))), 0), 7) AS INTEGER) AS bin FROM orders, m")
def _(t):
    o = t("orders")
    return o.select("o_orderkey", b.digitize(F.col("o_totalprice"), b.equal_width_edges(o, "o_totalprice", 8)).alias("bin"))


@query("bin_quantile", "WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) q FROM orders) SELECT o_orderkey, CAST((o_totalprice > q[1])::INT + (o_totalprice > q[2])::INT + (o_totalprice > q[3])::INT AS INTEGER) AS bin FROM orders, q")
def _(t):
    o = t("orders")
    return o.select("o_orderkey", b.digitize(F.col("o_totalprice"), b.quantile_edges(o, "o_totalprice", 4), right=True).alias("bin"))


@query("bin_entropy")
def _(t):
    o = t("orders")
    edges = b.entropy_edges(o, "o_totalprice", 6)
    return o.groupBy(b.digitize(F.col("o_totalprice"), edges).alias("bin")).agg(F.count("*").alias("n"))


@query("bin_chi_merge")
def _(t):
    x = t("lineitem")
    edges = b.chi_merge_edges(x, "l_quantity", "l_returnflag", 6, 4.6)
    return x.groupBy(b.digitize(F.col("l_quantity"), edges).alias("bin")).agg(F.count("*").alias("n"))


@query(
    "bin_information_value",
    f"""WITH b AS (SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS bin, {Y} AS y FROM lineitem), g AS (SELECT bin, count(*) AS n, CAST(sum(y) AS DOUBLE) AS events FROM b GROUP BY 1),
    s AS (SELECT *, (n - events + 0.5) / (sum(n - events) OVER () + 0.5) AS good, (events + 0.5) / (sum(events) OVER () + 0.5) AS bad FROM g)
    SELECT bin, n, events, round(ln(good / bad), 8) AS woe, round((good - bad) * ln(good / bad), 8) AS iv FROM s""",
)
def _(t):
    x = t("lineitem").select(F.floor(F.col("l_quantity") / 10).alias("bin"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return b.bin_statistics(x, "bin", "y").select("bin", "n", "events", F.round("woe", 8).alias("woe"), F.round("iv", 8).alias("iv"))
