"""Queries of the relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import relational as r
from quarry.plans.registry import query

H = "CAST('0x' || substr(md5(CAST({id} AS VARCHAR) || ':' || {seed}), 1, 15) AS BIGINT)"


def h(id_: str, seed: int = 0) -> str:
    return H.format(id=id_, seed=seed)


@query("column_slice", "SELECT c_custkey, c_mktsegment FROM customer")
def _(t):
    return r.select_columns(t("customer"), ["c_custkey", -1])


@query("condition_slice", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02")
def _(t):
    return r.where(t("lineitem"), "l_quantity > 45 AND l_discount < 0.02").select("l_orderkey", "l_linenumber")


@query("index_slice", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n >= 10 AND n < 5000 AND (n - 10) % 7 = 0")
def _(t):
    return r.rows_at(t("orders").select("o_orderkey"), ["o_orderkey"], 10, 5000, 7)


@query("index_positions", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS c FROM orders) WHERE n IN (0, 5, c - 1)")
def _(t):
    return r.rows_at(t("orders").select("o_orderkey"), ["o_orderkey"], positions=[0, 5, -1])


@query("dictionary_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(t):
    return r.map_values(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"O": "open", "F": "final"})


@query("dictionary_map_null", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' END AS o_orderstatus FROM orders")
def _(t):
    return r.map_values(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"O": "open"}, unknown="null")


@query("function_map", "SELECT c_custkey, round(c_acctbal * 2, 4) AS c_acctbal FROM customer")
def _(t):
    return r.map_columns(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], lambda x: F.round(x * 2, 4))


@query("merge_inner", "SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return r.merge([t("nation"), t("region").withColumnRenamed("r_regionkey", "n_regionkey")], ["n_regionkey"]).select("n_nationkey", "n_name", "n_regionkey", "r_name")


@query(
    "merge_outer_three",
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), c AS (SELECT n_nationkey + 3 AS k, n_name FROM nation)
    SELECT coalesce(a.k, b.k, c.k) AS k, a.n AS n, b.n AS n_y, n_name FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k""",
)
def _(t):
    a, b = (t(x).groupBy(F.col(k).alias("k")).agg(F.count("*").alias("n")) for x, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return r.merge([a, b, t("nation").select((F.col("n_nationkey") + 3).alias("k"), "n_name")], ["k"], "full")


@query(
    "merge_null_keys",
    """WITH a AS (SELECT CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_nationkey END AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_nationkey END AS k, count(*) AS m FROM supplier GROUP BY 1)
    SELECT a.k AS k, n, m FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""",
)
def _(t):
    key = lambda c: F.when(F.col(c) % 5 != 0, F.col(c)).alias("k")
    return r.merge([t("customer").groupBy(key("c_nationkey")).agg(F.count("*").alias("n")), t("supplier").groupBy(key("s_nationkey")).agg(F.count("*").alias("m"))], ["k"], null_keys_match=True)


@query("left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _(t):
    return r.left_join(t("customer"), t("orders"), ["c_custkey"], ["o_custkey"]).select("c_custkey", "o_orderkey")


@query("natural_merge", "SELECT s_suppkey, n_nationkey, n_name FROM (SELECT s_suppkey, s_nationkey AS n_nationkey FROM supplier) JOIN nation USING (n_nationkey)")
def _(t):
    return r.merge_on_common([t("supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), t("nation").select("n_nationkey", "n_name")])


@query("deep_merge", "SELECT n_nationkey, coalesce(n_name, '') || '/' || (n_regionkey + 1) AS merged FROM nation")
def _(t):
    n = t("nation")
    a = n.select("n_nationkey", F.create_map(F.lit("name"), "n_name", F.lit("region"), F.col("n_regionkey").cast("string")).alias("m"))
    b = n.select("n_nationkey", F.create_map(F.lit("region"), (F.col("n_regionkey") + 1).cast("string")).alias("m"))
    return r.merge_maps([a, b], ["n_nationkey"], "m").select("n_nationkey", F.concat_ws("/", F.col("m")["name"], F.col("m")["region"]).alias("merged"))


@query("concat_rows", "SELECT c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def _(t):
    return r.stack_rows([t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("b")), t("supplier").select(F.col("s_acctbal").alias("b"), F.col("s_nationkey").alias("k"))])


@query("concat_columns", "SELECT a.p_partkey, a.p_type, b.p_name, b.p_retailprice FROM (SELECT p_partkey, p_type, row_number() OVER (ORDER BY p_partkey) AS n FROM part) a JOIN (SELECT p_name, p_retailprice, row_number() OVER (ORDER BY p_name, p_partkey) AS n FROM part) b USING (n)")
def _(t):
    p = t("part")
    return r.stack_columns([p.select("p_partkey", "p_type"), p.select("p_name", "p_retailprice", F.col("p_partkey").alias("x"))], [["p_partkey"], ["p_name", "x"]]).drop("x")


for _keep, _sql in (("first", "row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1"), ("last", "row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"), (False, "count(*) OVER (PARTITION BY user_id, event_type) = 1")):

    @query(f"dedup_{_keep or 'none'}", f"SELECT event_id, user_id, event_type FROM events QUALIFY {_sql}")
    def _(t, keep=_keep):
        return r.drop_duplicates(t("events"), ["user_id", "event_type"], ["event_id"], keep).select("event_id", "user_id", "event_type")


@query("duplicate_groups", "SELECT user_id, event_type, count(*) AS n, count(*) - 1 AS extra FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return r.duplicate_groups(t("events"), ["user_id", "event_type"])


@query("shuffle_rows", f"SELECT o_orderkey, row_number() OVER (ORDER BY {h('o_orderkey', 7)}, o_orderkey) - 1 AS row_no FROM orders")
def _(t):
    return r.shuffled(t("orders").select("o_orderkey"), "o_orderkey", 7)


@query("random_split", f"SELECT o_orderkey, o_totalprice, o_orderdate, CASE WHEN n < floor(0.6 * c) THEN 0 WHEN n < floor(0.6 * c) + floor(0.2 * c) THEN 1 ELSE 2 END AS part FROM (SELECT o_orderkey, o_totalprice, o_orderdate, row_number() OVER (ORDER BY {h('o_orderkey', 3)}, o_orderkey) - 1 AS n, count(*) OVER () AS c FROM orders)")
def _(t):
    return r.random_split(t("orders").select("o_orderkey", "o_totalprice", "o_orderdate"), "o_orderkey", [0.6, 0.2], 3)


@query("stratified_split", f"SELECT o_orderkey, n <= greatest(1, floor(0.3 * c)) AS is_test FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {h('o_orderkey')}, o_orderkey) AS n, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders)")
def _(t):
    return r.stratified_split(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 0.3).select("o_orderkey", "is_test")


@query("stratified_folds", f"SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {h('o_orderkey')}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def _(t):
    return r.stratified_folds(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 5).select("o_orderkey", "fold")


@query(
    "contiguous_folds",
    f"""SELECT o_orderkey, CAST(CASE WHEN i < (c % 4) * (c // 4 + 1) THEN i // (c // 4 + 1) ELSE c % 4 + (i - (c % 4) * (c // 4 + 1)) // (c // 4) END AS INTEGER) AS fold
    FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {h("o_orderkey")}, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders)""",
)
def _(t):
    return r.stratified_folds(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 4, contiguous=True).select("o_orderkey", "fold")


@query("repeated_folds", "SELECT c_custkey, repeat, CAST(CAST('0x' || substr(md5(c_custkey || ':' || (1 + repeat)), 1, 15) AS BIGINT) % 5 AS INTEGER) AS fold FROM customer, (SELECT CAST(unnest(range(3)) AS INTEGER) AS repeat)")
def _(t):
    return r.repeated_folds(t("customer").select("c_custkey"), "c_custkey", 5, 3, 1)


@query(
    "time_series_split",
    """WITH o AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS n, count(*) OVER () AS c FROM events), s AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS split)
    SELECT event_id, value, split, CASE WHEN n < c - (3 - split) * 500 - 50 THEN 'train' ELSE 'test' END AS role FROM o, s
    WHERE n < c - (3 - split) * 500 - 50 OR (n >= c - (3 - split) * 500 AND n < c - (3 - split) * 500 + 500)""",
)
def _(t):
    return r.time_series_splits(t("events"), ["ts", "event_id"], 3, 500, 50).select("event_id", "value", "split", "role")


@query("crosstab", "SELECT o_orderpriority, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2), 0) AS F, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2), 0) AS O FROM orders GROUP BY 1")
def _(t):
    return r.crosstab(t("orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O"], F.round(F.sum("o_totalprice"), 2))


@query("crosstab_shares", "SELECT l_returnflag, round(count(*) FILTER (l_linestatus = 'F') / (SELECT count(*) FROM lineitem), 6) AS F, round(count(*) FILTER (l_linestatus = 'O') / (SELECT count(*) FROM lineitem), 6) AS O FROM lineitem GROUP BY 1")
def _(t):
    c = r.crosstab(t("lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"], F.count(F.lit(1)).cast("double"), normalize=True)
    return c.select("l_returnflag", F.round("F", 6).alias("F"), F.round("O", 6).alias("O"))


@query("feature_lookup", "SELECT i.k AS p_partkey, p_size, p_retailprice FROM (SELECT unnest([1, 5, 77, -3])::BIGINT AS k) i LEFT JOIN part ON p_partkey = i.k")
def _(t):
    p = t("part")
    ids = p.sparkSession.createDataFrame([(1,), (5,), (77,), (-3,)], "p_partkey long")
    return r.lookup(ids, p, "p_partkey", ["p_size", "p_retailprice"])


@query("update_constraints", "SELECT s_suppkey, 'immutable' AS rule, 's_nationkey' AS field FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT s_suppkey, 'monotonic', 's_acctbal' FROM supplier WHERE s_suppkey % 3 = 0")
def _(t):
    s = t("supplier")
    new = s.withColumn("s_nationkey", F.when(F.col("s_suppkey") % 10 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey"))).withColumn("s_acctbal", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal") - 1).otherwise(F.col("s_acctbal") + 1))
    return r.apply_updates_check(s, new, "s_suppkey", ["s_nationkey", "s_name"], ["s_acctbal"])
