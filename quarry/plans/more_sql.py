"""SQL of queries that are registered elsewhere."""

from __future__ import annotations

from quarry.operators.features import GEOHASH
from quarry.plans.analysis import _E, _PLACES
from quarry.plans.kernels import _DIST
from quarry.plans.registry import ORACLES

# _DIST gives r(query, id, d, n): every part's others by distance. The classes are brands.
_NAMED = _DIST + ", l AS (SELECT p_partkey i, p_brand b FROM part)"
ORACLES["tomek_links"] = _NAMED + " SELECT x.query AS a, x.id AS b FROM r x JOIN r y ON x.n = 1 AND y.n = 1 AND x.query = y.id AND x.id = y.query JOIN l p ON p.i = x.query JOIN l q ON q.i = x.id WHERE x.query < x.id AND p.b <> q.b"
_VOTE = ", v AS (SELECT query, b, count(*) c FROM r JOIN l ON i = id WHERE n <= {k} GROUP BY 1, 2), w AS (SELECT query, b FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, b) = 1)"
ORACLES["edited_neighbours"] = _NAMED + _VOTE.format(k=3) + " SELECT i AS p_partkey FROM w JOIN l ON i = query AND l.b = w.b"
ORACLES["knn_classify"] = (
    _DIST.replace("JOIN c b ON a.id <> b.id", "JOIN c b ON a.id % 5 = 0 AND b.id % 5 <> 0") + ", l AS (SELECT p_partkey i, p_brand b FROM part)" + _VOTE.format(k=5) + " SELECT query, b AS predicted FROM w"
)
ORACLES["local_outlier_factor"] = (
    _DIST + ", k AS (SELECT query, id, d FROM r WHERE n <= 10), f AS (SELECT query, max(d) far FROM k GROUP BY 1), g AS (SELECT k.query, 1 / (avg(greatest(d, far)) + 1e-12) lrd FROM k JOIN f ON f.query = k.id GROUP BY 1)"
    " SELECT k.query AS id, avg(o.lrd) / any_value(g.lrd) AS lof FROM k JOIN g o ON o.query = k.id JOIN g ON g.query = k.query GROUP BY 1"
)
ORACLES["chart_grid"] = "WITH m AS (SELECT min(l_quantity) a, max(l_quantity) b, min(l_discount) c, max(l_discount) d FROM lineitem), g AS (SELECT CAST(list_sum(list_transform(range(1, 10), lambda i: CAST(l_quantity >= a + (b - a) * i / 10 AS INTEGER))) AS INTEGER) bx, CAST(list_sum(list_transform(range(1, 5), lambda i: CAST(l_discount >= c + (d - c) * i / 5 AS INTEGER))) AS INTEGER) by_ FROM lineitem, m) SELECT bx, by_ AS by, count(*) AS n FROM g GROUP BY 1, 2"
ORACLES["gaussian_ranks"] = (
    "WITH r AS (SELECT c_custkey, (rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 - 0.5) / count(*) OVER () p FROM customer), t AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) t FROM r),"
    " z AS (SELECT c_custkey, p, t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) z FROM t) SELECT c_custkey, CASE WHEN p < 0.5 THEN -z ELSE z END AS z FROM z"
)
# Two values are mirrored at either end: 1 0 | 0 1 2.
ORACLES["median_filter"] = (
    "WITH o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 i, count(*) OVER (PARTITION BY user_id) n FROM events),"
    " w AS (SELECT event_id, user_id, n, CASE WHEN i + k < 0 THEN -1 - (i + k) WHEN i + k >= n THEN 2 * n - 1 - (i + k) ELSE i + k END j FROM o, (SELECT unnest([-2, -1, 0, 1, 2]) k))"
    " SELECT w.event_id, median(o.value) AS filtered FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.j GROUP BY 1"
)
ORACLES["chi_square_p_value"] = (  # two degrees of freedom: the law is exponential
    "WITH c AS (SELECT l_returnflag r, l_linestatus s, count(*) o FROM lineitem GROUP BY ALL), x AS (SELECT r, s, coalesce(o, 0) o FROM (SELECT DISTINCT r FROM c) CROSS JOIN (SELECT DISTINCT s FROM c) LEFT JOIN c USING (r, s)),"
    " e AS (SELECT o, sum(o) OVER (PARTITION BY r) * sum(o) OVER (PARTITION BY s) / sum(o) OVER () e FROM x) SELECT sum((o - e) ** 2 / e) AS chi2, exp(-sum((o - e) ** 2 / e) / 2) AS p FROM e"
)
_STEPS = "".join(f", d{i + 1} AS (SELECT node, min(d) d FROM (SELECT * FROM d{i} UNION ALL SELECT dst, d + w FROM d{i} JOIN e ON src = node) GROUP BY 1)" for i in range(24))  # 25 nations
ORACLES["shortest_paths"] = f"WITH {_E}, d0 AS (SELECT 0 AS node, 0.0::DOUBLE AS d){_STEPS} SELECT node, d AS distance FROM d24"
_BITS = "list_transform(range(35), lambda i: CASE WHEN i % 2 = 0 THEN (a >> (17 - i // 2)) & 1 ELSE (b >> (16 - i // 2)) & 1 END)"
ORACLES["geohash"] = (
    f"WITH {_PLACES}, c AS (SELECT k, least(CAST(floor((lon + 180) / 360 * 262144) AS BIGINT), 262143) a, least(CAST(floor((lat + 90) / 180 * 131072) AS BIGINT), 131071) b FROM p), z AS (SELECT k, {_BITS} s FROM c)"
    f" SELECT k, array_to_string(list_transform(range(7), lambda d: substr('{GEOHASH}', CAST(s[5 * d + 1] * 16 + s[5 * d + 2] * 8 + s[5 * d + 3] * 4 + s[5 * d + 4] * 2 + s[5 * d + 5] + 1 AS INTEGER), 1)), '') AS geohash FROM z"
)
ORACLES["partial_correlations"] = (  # of four columns, the residuals of two on the other two, by their correlations
    "WITH c AS (SELECT corr(l_quantity, l_extendedprice) ab, corr(l_quantity, l_discount) ac, corr(l_quantity, l_tax) ad, corr(l_extendedprice, l_discount) bc, corr(l_extendedprice, l_tax) bd, corr(l_discount, l_tax) cd FROM lineitem),"
    " f AS (SELECT unnest([{'a': 'l_quantity', 'b': 'l_extendedprice', 'r': ab, 'xu': ac, 'xv': ad, 'yu': bc, 'yv': bd, 'uv': cd}, {'a': 'l_quantity', 'b': 'l_discount', 'r': ac, 'xu': ab, 'xv': ad, 'yu': bc, 'yv': cd, 'uv': bd}, {'a': 'l_quantity', 'b': 'l_tax', 'r': ad, 'xu': ab, 'xv': ac, 'yu': bd, 'yv': cd, 'uv': bc},"
    " {'a': 'l_extendedprice', 'b': 'l_discount', 'r': bc, 'xu': ab, 'xv': bd, 'yu': ac, 'yv': cd, 'uv': ad}, {'a': 'l_extendedprice', 'b': 'l_tax', 'r': bd, 'xu': ab, 'xv': bc, 'yu': ad, 'yv': cd, 'uv': ac}, {'a': 'l_discount', 'b': 'l_tax', 'r': cd, 'xu': ac, 'xv': bc, 'yu': ad, 'yv': bd, 'uv': ab}], recursive := true) FROM c),"
    " g AS (SELECT a, b, (r - xu * yu) / sqrt((1 - xu ** 2) * (1 - yu ** 2)) xy, (xv - xu * uv) / sqrt((1 - xu ** 2) * (1 - uv ** 2)) xv, (yv - yu * uv) / sqrt((1 - yu ** 2) * (1 - uv ** 2)) yv FROM f)"
    " SELECT a, b, (xy - xv * yv) / sqrt((1 - xv ** 2) * (1 - yv ** 2)) AS r FROM g"
)
ORACLES["chart_density"] = (
    "WITH s AS (SELECT count(*) n, stddev_samp(o_totalprice) s, min(o_totalprice) a, max(o_totalprice) b FROM orders), d AS (SELECT CAST(least(floor((o_totalprice - a) / (b - a) * 512), 511) AS INTEGER) k FROM orders, s), h AS (SELECT k, count(*) c FROM d GROUP BY 1),"
    " f AS (SELECT a + (b - a) * (k + 0.5) / 512 m, c FROM h, s), x AS (SELECT a + (b - a) * 0.5 / 512 + i * ((b - a) * 511.0 / 512 / 63) x FROM s, (SELECT unnest(range(64)) i))"
    " SELECT x, (SELECT sum(c * exp(-0.5 * ((x - m) / (1.06 * s * n ** -0.2)) ** 2)) / any_value(n * 1.06 * s * n ** -0.2 * sqrt(2 * pi())) FROM f, s) AS density FROM x"
)
