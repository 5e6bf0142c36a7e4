"""Queries of matrices, samples, drift and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.special import norm_cdf_sql
from quarry.operators import drift as d
from quarry.operators import matrices as m
from quarry.operators import sampling as s
from quarry.operators import text as x
from quarry.plans.analysis import one_row, rounded
from quarry.plans.registry import query
from quarry.plans.relational import h


def _m(t):
    return m.to_cells(t("part"), "p_partkey", ["p_size", "p_retailprice"])


_CELLS = "m AS (SELECT p_partkey i, unnest([0, 1])::BIGINT j, unnest([p_size::DOUBLE, p_retailprice]) v FROM part)"
query("matrix_transpose", f"WITH {_CELLS} SELECT j AS i, i AS j, v FROM m WHERE v <> 0")(lambda t: m.transpose(_m(t)))
query("matrix_gram", f"WITH {_CELLS} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 2) AS v FROM m a JOIN m b USING (i) GROUP BY 1, 2")(lambda t: rounded(m.multiply(m.transpose(_m(t)), _m(t)), 2))
query("matrix_norm", f"WITH {_CELLS} SELECT round(sqrt(sum(v * v)), 4) AS norm FROM m")(lambda t: rounded(m.frobenius(_m(t)), 4))


@query(
    "vector_distances",
    """WITH p AS (SELECT a.vec_id, a.embedding a, b.embedding b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    z AS (SELECT vec_id, list_sum(list_transform(list_zip(a, b), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) ab, list_sum(list_transform(a, lambda v: v::DOUBLE * v::DOUBLE)) aa, list_sum(list_transform(b, lambda v: v::DOUBLE * v::DOUBLE)) bb, list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) l1 FROM p)
    SELECT vec_id, round(ab / (sqrt(aa) * sqrt(bb)), 5) AS cosine, round(l1, 5) AS manhattan, round(sqrt(aa + bb - 2 * ab), 4) AS euclidean FROM z""",
)
def _(t):
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    p = e.join(b, "vec_id")
    return p.select("vec_id", F.round(m.cosine(F.col("a"), F.col("b")), 5).alias("cosine"), F.round(m.manhattan(F.col("a"), F.col("b")), 5).alias("manhattan"), F.round(m.euclidean(F.col("a"), F.col("b")), 4).alias("euclidean"))


@query("boolean_operations", "SELECT l_orderkey, l_linenumber, l_quantity > 20 AND l_tax > 0.03 AS both, (l_quantity > 20) <> (l_tax > 0.03) AS one FROM lineitem")
def _(t):
    a, b = F.col("l_quantity") > 20, F.col("l_tax") > 0.03
    return t("lineitem").select("l_orderkey", "l_linenumber", (a & b).alias("both"), (a != b).alias("one"))


query("sample_fraction", f"SELECT o_orderkey FROM orders WHERE {h('o_orderkey', 5)} / 1152921504606846976 < 0.2")(lambda t: s.fraction(t("orders"), "o_orderkey", 0.2, 5).select("o_orderkey"))
query("sample_exactly", f"SELECT o_orderkey FROM orders ORDER BY {h('o_orderkey', 5)}, o_orderkey LIMIT 321")(lambda t: s.exactly(t("orders"), "o_orderkey", 321, 5).select("o_orderkey"))
query("sample_bootstrap", "WITH c AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 p, count(*) OVER () n FROM customer), d AS (SELECT unnest(range(700)) AS draw) SELECT draw, c_custkey, c_acctbal FROM d JOIN c ON p = CAST('0x' || substr(md5(draw || ':' || 9), 1, 15) AS BIGINT) % n")(lambda t: s.bootstrap(t("customer").select("c_custkey", "c_acctbal"), "c_custkey", 700, 9))
query("sample_per_class", f"SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {h('o_orderkey', 1)}, o_orderkey) <= 50")(lambda t: s.per_class(t("orders"), "o_orderkey", "o_orderpriority", 50, 1).select("o_orderkey"))
query("sample_stratified", f"SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY {h('o_orderkey', 2)}, o_orderkey) <= ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.1)")(lambda t: s.proportional(t("orders"), "o_orderkey", "o_orderstatus", 0.1, 2).select("o_orderkey"))
query("sample_weighted", f"SELECT o_orderkey FROM orders ORDER BY ln(({h('o_orderkey', 4)} + 1) / 1152921504606846977) / o_totalprice DESC, o_orderkey LIMIT 200")(lambda t: s.weighted(t("orders"), "o_orderkey", "o_totalprice", 200, 4).select("o_orderkey"))
query("mini_batches", f"SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY {h('o_orderkey', 6)}, o_orderkey) - 1) // 128 AS batch FROM orders")(lambda t: s.mini_batches(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 128, 6))
query("perturbation", f"SELECT c_custkey, round(c_acctbal + ({h('c_custkey', 8)} / 1152921504606846976 * 2 - 1) * 10, 6) AS c_acctbal FROM customer")(lambda t: rounded(s.perturbed(t("customer").select("c_custkey", "c_acctbal"), "c_custkey", ["c_acctbal"], 10.0, 8)))
query("mixing", "SELECT c_custkey, round(0.7 * c_acctbal + 0.3 * coalesce(lead(c_acctbal) OVER (ORDER BY c_custkey), first_value(c_acctbal) OVER (ORDER BY c_custkey)), 6) AS c_acctbal FROM customer")(lambda t: rounded(s.mixed(t("customer"), "c_custkey", ["c_acctbal"], 0.7)))


@query("kolmogorov_smirnov_normal", f"WITH s AS (SELECT count(*) n, avg(o_totalprice) m, stddev_samp(o_totalprice) s FROM orders), v AS (SELECT o_totalprice x, count(*) c FROM orders GROUP BY 1), w AS (SELECT x, c, sum(c) OVER (ORDER BY x) hi FROM v), p AS (SELECT n, hi, c, {norm_cdf_sql('((x - m) / s)')} p FROM w, s) SELECT n, round(max(greatest(hi / n - p, p - (hi - c) / n)), 6) AS d FROM p GROUP BY 1")
def _(t):
    return rounded(d.ks_normal(t("orders"), "o_totalprice"))


@query("chi_square_fit", "WITH c AS (SELECT count(*) o FROM orders GROUP BY o_orderpriority) SELECT count(*) AS k, round(sum((o - e) ** 2 / e), 6) AS chi2 FROM c, (SELECT avg(o) e FROM c)")
def _(t):
    return rounded(d.chi_square_fit(t("orders"), "o_orderpriority"))


@query("linear_mmd", "WITH s AS (SELECT count(*) FILTER (r) nr, count(*) FILTER (NOT r) nc, sum(v) FILTER (r) sr, sum(v) FILTER (NOT r) sc, sum(v * v) FILTER (r) qr, sum(v * v) FILTER (NOT r) qc FROM (SELECT l_quantity v, l_shipdate < TIMESTAMP '1995-06-01' r FROM lineitem)) SELECT round((sr * sr - qr) / (nr::DOUBLE * (nr - 1)) + (sc * sc - qc) / (nc::DOUBLE * (nc - 1)) - 2 * sr * sc / (nr::DOUBLE * nc), 6) AS mmd2 FROM s")
def _(t):
    return rounded(d.linear_mmd(t("lineitem"), ["l_quantity"], F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp_ntz")))


@query("partial_correlations")
def _(t):
    x_ = t("lineitem")
    return x_.sparkSession.createDataFrame(d.partial_correlations(x_, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "a string, b string, r double")


@query("phillips_perron", "WITH l AS (SELECT user_id, value y, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) x FROM events), s AS (SELECT user_id, count(*) n, regr_slope(y, x) rho, regr_sxx(y, x) sxx, regr_syy(y, x) syy, regr_sxy(y, x) sxy FROM l WHERE x IS NOT NULL GROUP BY 1) SELECT user_id, n, round(rho, 6) AS rho, round((rho - 1) / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 5) AS t FROM s WHERE n > 2 AND sxx > 0")
def _(t):
    r = d.phillips_perron(t("events"), "value", ["user_id"], ["ts", "event_id"])
    return r.select("user_id", "n", F.round("rho", 6).alias("rho"), F.round("t", 5).alias("t"))


@query("granger")
def _(t):
    e = t("events").withColumn("other", F.hour("ts").cast("double"))
    return one_row(t("events"), d.granger(e, "value", "other", ["ts", "event_id"], ["user_id"], 2))


@query("ljung_box", "WITH c AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) d FROM events), l AS (SELECT user_id, d, lag(d, 1) OVER w a, lag(d, 2) OVER w b FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, count(*) n, sum(d * a) / sum(d * d) r1, sum(d * b) / sum(d * d) r2 FROM l GROUP BY 1) SELECT user_id, n, round(n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)), 5) AS q FROM s")
def _(t):
    return rounded(d.ljung_box(t("events"), "value", ["user_id"], ["ts", "event_id"], 2), 5)


@query("gaussian_ranks")
def _(t):
    return d.gaussian_ranks(t("customer"), "c_acctbal", "c_custkey").select("c_custkey", "z")


@query("similarity_encoding", "SELECT p_partkey, round(1 - levenshtein(p_brand, 'Brand#11') / greatest(length(p_brand), 8), 6) AS likeness FROM part")
def _(t):
    b = F.col("p_brand")
    return t("part").select("p_partkey", F.round(1 - F.levenshtein(b, F.lit("Brand#11")) / F.greatest(F.length(b), F.lit(8)), 6).alias("likeness"))


@query("kmer_similarity")
def _(t):
    return t("part").select("p_partkey", F.round(x.kmer_cosine(F.col("p_type"), F.lit("STANDARD POLISHED BRASS"), 2), 6).alias("likeness"))
