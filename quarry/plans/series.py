"""Queries of cleaning, validation, text, date-time, time series and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import streaming
from quarry.functions.special import norm_cdf_sql
from quarry.operators import cleaning as c
from quarry.operators import text as x
from quarry.operators import timeseries as ts
from quarry.plans.analysis import rounded
from quarry.plans.registry import query

# Cleaning: every seventh order's quantity is taken away first, in both engines.
_L = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS q, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_returnflag END AS f FROM lineitem)"


def _holes(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("q"), F.when(F.col("l_partkey") % 11 != 0, F.col("l_returnflag")).alias("f"))


query("drop_null_rows", f"SELECT * FROM {_L} WHERE q IS NOT NULL AND f IS NOT NULL")(lambda t: c.drop_null_rows(_holes(t)))
query("missingness", f"SELECT 'q' AS name, count(*) FILTER (q IS NULL) AS missing, round(count(*) FILTER (q IS NULL) / count(*), 8) AS share FROM {_L} UNION ALL SELECT 'f', count(*) FILTER (f IS NULL), round(count(*) FILTER (f IS NULL) / count(*), 8) FROM {_L}")(lambda t: rounded(c.missingness(_holes(t), ["q", "f"]), 8))
query("missingness_correlation", f"SELECT 'q' AS a, 'f' AS b, round(corr(CAST(q IS NULL AS DOUBLE), CAST(f IS NULL AS DOUBLE)), 6) + 0.0 AS r FROM {_L}")(lambda t: rounded(c.missingness_correlation(_holes(t), ["q", "f"])))
query("drop_null_columns", f"SELECT l_orderkey, l_linenumber, f FROM {_L}")(lambda t: c.drop_null_columns(_holes(t), 0.12))


def _filled(fit, *cols):
    def run(t):
        d = _holes(t)
        return rounded(c.fill(d, fit(d, cols)).select("l_orderkey", "l_linenumber", *cols))

    return run


query("impute_mean", f"SELECT l_orderkey, l_linenumber, round(coalesce(q, avg(q) OVER ()), 6) AS q FROM {_L}")(_filled(c.fit_means, "q"))
query("impute_median", f"SELECT l_orderkey, l_linenumber, round(coalesce(q, (SELECT median(q) FROM {_L})), 6) AS q FROM {_L}")(_filled(c.fit_medians, "q"))
query("impute_mode", f"WITH m AS (SELECT f FROM {_L} WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1) SELECT l_orderkey, l_linenumber, coalesce(a.f, m.f) AS f FROM {_L} a, m")(_filled(c.fit_modes, "f"))

_EV = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events)"


def _gaps(t):
    return t("events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"))


def _fill(**kw):
    return lambda t: c.fill_along(_gaps(t), "v", ["user_id"], ["ts", "event_id"], **kw).select("event_id", "v")


_WIN = "PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN"
query("forward_fill", f"SELECT event_id, last_value(v IGNORE NULLS) OVER ({_WIN} UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM {_EV}")(_fill())
query("backward_fill_limit", f"SELECT event_id, first_value(v IGNORE NULLS) OVER ({_WIN} CURRENT ROW AND 2 FOLLOWING) AS v FROM {_EV}")(_fill(direction="backward", limit=2))
query("fill_both", f"SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER ({_WIN} UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER ({_WIN} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM {_EV}")(_fill(direction="both"))


@query(
    "linear_interpolation",
    """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 4 <> 0 THEN value END v FROM events),
    n AS (SELECT event_id, v, last_value(v IGNORE NULLS) OVER a y0, first_value(v IGNORE NULLS) OVER b y1, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER a x0, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b x1 FROM e
      WINDOW a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(coalesce(v, y0 + (y1 - y0) * (event_id - x0) / nullif(x1 - x0, 0)), 6) AS v FROM n""",
)
def _(t):
    return rounded(c.fill_linear(_gaps(t), "v", ["user_id"], "event_id").select("event_id", "v"))


@query("grubbs", "WITH s AS (SELECT count(*) n, avg(o_totalprice) m, stddev_samp(o_totalprice) s, min(o_totalprice) lo, max(o_totalprice) hi FROM orders) SELECT n, CASE WHEN hi - m >= m - lo THEN hi ELSE lo END AS extreme, round(greatest(hi - m, m - lo) / s, 6) AS g FROM s")
def _(t):
    return c.grubbs(t("orders"), "o_totalprice").select("n", "extreme", F.round("g", 6).alias("g"))


@query("chauvenet", f"WITH s AS (SELECT count(*) n, avg(value) m, stddev_pop(value) s FROM events) SELECT event_id, 2 * (1 - {norm_cdf_sql('(abs(value - m) / s)')}) < 1 / (2 * n) AS is_outlier FROM events, s")
def _(t):
    return c.chauvenet(t("events").select("event_id", "value"), "value").drop("value")


# Validation


@query(
    "validation_suite",
    """WITH s AS (SELECT count(*) n, count(*) FILTER (l_quantity < 2 OR l_quantity >= 50) a, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) b, count(*) FILTER (l_discount > 0.08) c FROM lineitem)
    SELECT 'quantity' AS rule, a AS broken, n AS checked FROM s UNION ALL SELECT 'flag', b, n FROM s UNION ALL SELECT 'discount', c, n FROM s""",
)
def _(t):
    q = F.col
    return c.violations(t("lineitem"), {"quantity": c.out_of_range(q("l_quantity"), 2, 50, include_high=False), "flag": c.not_in_domain(q("l_returnflag"), ["A", "N"]), "discount": c.out_of_range(q("l_discount"), None, 0.08)})


@query("format_validation", "WITH s AS (SELECT count(*) n, count(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]+$')) a, count(*) FILTER (try_cast(c_mktsegment AS DOUBLE) IS NULL) b, count(*) FILTER (try_strptime(c_name, '%Y') IS NULL) d FROM customer) SELECT 'name' AS rule, a AS broken, n AS checked FROM s UNION ALL SELECT 'numeric', b, n FROM s UNION ALL SELECT 'date', d, n FROM s")
def _(t):
    q = F.col
    return c.violations(t("customer"), {"name": c.breaks_pattern(q("c_name"), "^Customer#[0-9]+$"), "numeric": c.not_numeric(q("c_mktsegment")), "date": c.not_a_date(q("c_name"), "yyyy")})


@query("email_validation", "SELECT 'email' AS rule, count(*) FILTER (NOT regexp_matches(e, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$')) AS broken, count(*) AS checked FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey || '@example.com' ELSE 'c@' || c_custkey END e FROM customer)")
def _(t):
    e = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("c"), "c_custkey", F.lit("@example.com"))).otherwise(F.concat(F.lit("c@"), "c_custkey"))
    return c.violations(t("customer").select(e.alias("e")), {"email": c.breaks_pattern(F.col("e"), c.EMAIL)})


@query("unique_constraints", "SELECT 'l_orderkey' AS fields, CAST(sum(n - 1) AS BIGINT) AS extra FROM (SELECT count(*) n FROM lineitem GROUP BY l_orderkey) UNION ALL SELECT 'l_orderkey+l_linenumber', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def _(t):
    return c.unique_violations(t("lineitem"), [["l_orderkey"], ["l_orderkey", "l_linenumber"]])


@query("freshness", "SELECT 'age' AS rule, count(*) FILTER (ts < TIMESTAMP '2024-01-30' - INTERVAL 72 HOUR) AS broken, count(*) AS checked FROM events")
def _(t):
    return c.violations(t("events"), {"age": c.too_old(F.col("ts"), "2024-01-30 00:00:00", 72)})


@query("quality_report", " UNION ALL ".join(f"SELECT '{k}' AS name, CAST(1 AS DOUBLE) AS completeness, round(count(DISTINCT {k}) / count(*), 8) AS uniqueness, round(avg({k}), 8) AS mean, round(stddev_pop({k}), 8) AS std, round(median({k}), 8) AS median FROM lineitem" for k in ("l_quantity", "l_discount")))
def _(t):
    return rounded(c.quality_report(t("lineitem"), ["l_quantity", "l_discount"]), 8)


_CUT = "(l_shipdate < TIMESTAMP '1995-06-01')"


@query(
    "stability_index",
    f"""WITH m AS (SELECT min(l_extendedprice) a, max(l_extendedprice) b FROM lineitem), d AS (SELECT least(list_sum(list_transform(range(1, 10), lambda i: CAST(l_extendedprice >= a + (b - a) * i / 10 AS INTEGER))), 9) bin, {_CUT} r FROM lineitem, m),
    g AS (SELECT bin, count(*) FILTER (r) r, count(*) FILTER (NOT r) c FROM d GROUP BY 1), p AS (SELECT greatest(r / sum(r) OVER (), 1e-4) p, greatest(c / sum(c) OVER (), 1e-4) q FROM g) SELECT round(sum((q - p) * ln(q / p)), 8) AS psi FROM p""",
)
def _(t):
    return rounded(c.stability_index(t("lineitem"), "l_extendedprice", F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp_ntz")), 8)


@query("quantile_drift", f"WITH s AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) FILTER {_CUT.replace('(', '(WHERE ', 1)} r, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) FILTER (WHERE NOT {_CUT}) c FROM lineitem), u AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS q, unnest(r) AS reference, unnest(c) AS current FROM s) SELECT q, round(reference, 6) AS reference, round(current, 6) AS current, abs(current - reference) > 300 AS drifted FROM u")
def _(t):
    return rounded(c.quantile_drift(t("lineitem"), "l_extendedprice", F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp_ntz"), [0.25, 0.5, 0.75], 300))


# Text


@query("uppercase", "SELECT p_partkey, upper(p_name) AS p_name FROM part")
def _(t):
    return t("part").select("p_partkey", F.upper("p_name").alias("p_name"))


@query("remove_special", "SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9\\s_]', '', 'g') AS p_name FROM part")
def _(t):
    return t("part").select("p_partkey", x_clean(F.col("p_name")).alias("p_name"))


def x_clean(col):
    return c.without_special(col, "_")


@query("invalid_characters", "SELECT p_partkey, length(p_type) - length(regexp_replace(p_type, '[^A-Z ]', '', 'g')) AS bad FROM part")
def _(t):
    return t("part").select("p_partkey", c.invalid_characters(F.col("p_type"), "A-Z ").cast("long").alias("bad"))


@query("replace_words", r"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '\bTHE\b', 'DER', 'g'), '\bThe\b', 'Der', 'g'), '\bthe\b', 'der', 'g') AS text FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", c.replaced_words(F.col("text"), {"the": "der"}).alias("text"))


_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query("bigram_counts", f"WITH t AS (SELECT {_TOK} w FROM conversations), g AS (SELECT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t) SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 3")
def _(t):
    return x.gram_counts(t("conversations"), x.word_ngrams(x.split_words(F.col("text")), 2), 3)


@query("trigram_counts", f"WITH t AS (SELECT {_TOK} w FROM conversations), g AS (SELECT unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM t) SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    return x.gram_counts(t("conversations"), x.word_ngrams(x.split_words(F.col("text")), 3), 2)


@query("char_ngram_counts", "WITH g AS (SELECT unnest(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))) AS gram FROM part) SELECT gram, count(*) AS n FROM g GROUP BY 1")
def _(t):
    return x.gram_counts(t("part"), x.char_ngrams(F.col("p_name"), 3))


@query("stop_words", "SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '' AND lower(w) NOT IN (" + ", ".join(f"'{w}'" for w in x.STOP_WORDS) + ")), ' ') AS text FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", x.without_stop_words(F.col("text")).alias("text"))


@query("vocabulary", f"WITH c AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOK}) AS token FROM conversations) GROUP BY 1) SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS token_id FROM c ORDER BY n DESC, token LIMIT 200")
def _(t):
    return x.vocabulary(t("conversations"), x.split_words(F.col("text")), 200)


@query("tf_idf", f"WITH t AS (SELECT page_id, {_TOK.replace('text', 'url')} w FROM pages), e AS (SELECT page_id, len(w) AS l, unnest(w) AS token FROM t), f AS (SELECT page_id, token, l, count(*) c FROM e GROUP BY ALL), d AS (SELECT token, ln((SELECT count(*) FROM pages)::DOUBLE / (count(*) + 1)) + 1 idf FROM f GROUP BY 1) SELECT page_id, token, round(c / l, 8) AS tf, round(idf, 8) AS idf, round(c / l * idf, 8) AS tfidf FROM f JOIN d USING (token)")
def _(t):
    return rounded(x.tf_idf(t("pages"), "page_id", x.split_words(F.col("url"))), 8)


@query("substring_search", "SELECT p_partkey, len(list_filter(range(1, length(p_name) + 1), lambda i: substr(p_name, i, 2) = 'ar'))::BIGINT AS hits FROM part")
def _(t):
    return t("part").select("p_partkey", F.size(x.find_all(F.col("p_name"), "ar")).cast("long").alias("hits"))


# Date-time


@query("date_parts", "SELECT event_id, CAST(year(ts) AS BIGINT) AS year, quarter(ts) AS quarter, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, (isodow(ts) - 1) AS weekday, dayofyear(ts) AS day_of_year, week(ts) AS week, isodow(ts) >= 6 AS is_weekend, day(ts) = 1 AS is_month_start, last_day(ts) = CAST(ts AS DATE) AS is_month_end, dayofyear(ts) = 1 AS is_year_start FROM events")
def _(t):
    parts = x.date_parts(F.col("ts"))
    return t("events").select("event_id", *((v.cast("long") if not k.startswith("is_") else v).alias(k) for k, v in parts.items()))


@query("epochs", "SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS h, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS d FROM events")
def _(t):
    return t("events").select("event_id", *(x.epoch(F.col("ts"), u).alias(u) for u in ("s", "h", "d")))


@query("business_days", "WITH e AS (SELECT event_id, ts, CAST(ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-15') AS off FROM events) SELECT event_id, isodow(ts) < 6 AND NOT off AS is_business_day, off AS is_holiday, isodow(ts) = 1 AS is_monday, isodow(ts) = 5 AS is_friday, last_day(ts) = CAST(ts AS DATE) AND month(ts) IN (3, 6, 9, 12) AS is_quarter_end, isodow(ts) < 6 AND NOT off AND hour(ts) >= 9 AND hour(ts) < 17 AS is_business_hour FROM e")
def _(t):
    return t("events").select("event_id", *(v.alias(k) for k, v in x.business_flags(F.col("ts"), ["2024-01-01", "2024-01-15"]).items()))


@query("time_zones", "SELECT event_id, CAST(hour(ts + INTERVAL 9 HOUR) AS BIGINT) AS hour FROM events")
def _(t):
    return t("events").select("event_id", F.hour(x.to_zone(F.col("ts"), "UTC", "Asia/Tokyo")).cast("long").alias("hour"))


# Time series: a user's events in order.
KEY, ORDER = ["user_id"], ["ts", "event_id"]
_W = "PARTITION BY user_id ORDER BY ts, event_id"


@query("lags", f"SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 3) OVER w AS value_lag_3 FROM events WINDOW w AS ({_W}) QUALIFY row_number() OVER w > 3")
def _(t):
    return ts.lags(t("events").select("event_id", "user_id", "ts", "value"), "value", KEY, ORDER, [1, 3], drop_incomplete=True).select("event_id", "value_lag_1", "value_lag_3")


for _how, _f in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("std", "stddev_samp"), ("median", "median")):

    @query(f"rolling_{_how}", f"SELECT event_id, round(CASE WHEN count(value) OVER w >= 3 THEN {_f}(value) OVER w END, 6) AS v FROM events WINDOW w AS ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
    def _(t, how=_how):
        return rounded(ts.rolling(t("events").select("event_id", "user_id", "ts", "value"), "value", KEY, ORDER, 5, how, least=3, name="v").select("event_id", "v"))


@query("rolling_centred", f"SELECT event_id, round(CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END, 6) AS v FROM events WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def _(t):
    return rounded(ts.rolling(t("events").select("event_id", "user_id", "ts", "value"), "value", KEY, ORDER, 5, center=True, name="v").select("event_id", "v"))


@query("moving_windows", f"SELECT user_id, n - 1 AS start, round(list_sum(v), 6) AS total FROM (SELECT user_id, row_number() OVER ({_W}) AS n, list(value) OVER ({_W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS v FROM events) WHERE len(v) = 4 AND (n - 1) % 2 = 0")
def _(t):
    w = ts.windows(t("events"), "value", KEY, ORDER, 4, 2)
    return w.select("user_id", F.col("start").cast("long").alias("start"), F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("ewma", f"WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER ({_W}) n FROM events), e(event_id, user_id, n, m) AS (SELECT event_id, user_id, n, value FROM o WHERE n = 1 UNION ALL SELECT o.event_id, o.user_id, o.n, 0.3 * o.value + 0.7 * e.m FROM e JOIN o ON o.user_id = e.user_id AND o.n = e.n + 1) SELECT event_id, round(m, 6) AS ewma FROM e")
def _(t):
    return rounded(ts.ewma(t("events").select("event_id", "user_id", "ts", "value"), "value", KEY, ORDER, 0.3).select("event_id", "ewma"))


@query("autocorrelation", f"WITH d AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) d FROM events), l AS (SELECT user_id, d, lag(d, 1) OVER ({_W}) a, lag(d, 2) OVER ({_W}) b FROM d), s AS (SELECT user_id, sum(d * a) / sum(d * d) r1, sum(d * b) / sum(d * d) r2 FROM l GROUP BY 1) SELECT user_id, unnest([1, 2]) AS lag, round(unnest([r1, r2]), 6) AS r FROM s")
def _(t):
    return rounded(ts.autocorrelation(t("events"), "value", KEY, ORDER, [1, 2]))


_SEAS = f"a AS (SELECT event_id, user_id, value, (row_number() OVER ({_W}) - 1) % 7 AS phase, avg(value) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM events), b AS (SELECT *, avg(value - trend) OVER (PARTITION BY user_id, phase) AS season FROM a), r AS (SELECT *, value - trend - season AS residual FROM b)"


@query("seasonal_decomposition", f"WITH {_SEAS} SELECT event_id, round(trend, 6) AS trend, round(season, 6) AS season, round(residual, 6) + 0.0 AS residual FROM r")
def _(t):
    return rounded(ts.seasonal_residuals(t("events"), "value", KEY, ORDER, 7).select("event_id", "trend", "season", "residual"))


@query("seasonal_anomalies", f"WITH {_SEAS} SELECT event_id, coalesce(abs((residual - avg(residual) OVER (PARTITION BY user_id)) / nullif(stddev_pop(residual) OVER (PARTITION BY user_id), 0)) > 2.2, false) AS is_anomaly FROM r")
def _(t):
    return ts.seasonal_anomalies(t("events"), "value", KEY, ORDER, 7, 2.2).select("event_id", "is_anomaly")


@query("kpss", f"WITH e AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) e FROM events), l AS (SELECT user_id, e, sum(e) OVER ({_W}) s, lag(e, 1) OVER ({_W}) a, lag(e, 2) OVER ({_W}) b FROM e) SELECT user_id, count(*) AS n, round(sum(s * s) / count(*) / (sum(e * e) + 2 * (1 - 1 / 3) * sum(e * a) + 2 * (1 - 2 / 3) * sum(e * b)), 6) AS kpss FROM l GROUP BY 1")
def _(t):
    return rounded(ts.kpss(t("events"), "value", KEY, ORDER, 2))


@query("control_chart", f"WITH a AS (SELECT event_id, user_id, value, abs(value - lag(value) OVER ({_W})) m FROM events), b AS (SELECT *, avg(value) OVER (PARTITION BY user_id) c, 2.66 * avg(m) OVER (PARTITION BY user_id) r FROM a) SELECT event_id, round(c, 6) AS center, round(c - r, 6) AS low, round(c + r, 6) AS high, value < c - r OR value > c + r AS out_of_control FROM b")
def _(t):
    return rounded(ts.control_limits(t("events"), "value", KEY, ORDER).select("event_id", "center", "low", "high", "out_of_control"))


@query("process_capability", "SELECT event_type, round(100 / (6 * stddev_samp(value)), 6) AS cp, round(least(100 - avg(value), avg(value)) / (3 * stddev_samp(value)), 6) AS cpk FROM events GROUP BY 1")
def _(t):
    return rounded(ts.capability(t("events"), "value", 0.0, 100.0, ["event_type"]))


@query("regime_shifts", f"SELECT event_id, coalesce(count(value) OVER a = 5 AND count(value) OVER b = 5 AND abs(avg(value) OVER b - avg(value) OVER a) > 1.5 * sqrt((var_pop(value) OVER a + var_pop(value) OVER b) / 2), false) AS is_shift FROM events WINDOW a AS ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b AS ({_W} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)")
def _(t):
    return ts.shifts(t("events"), "value", KEY, ORDER, 5, 1.5).select("event_id", "is_shift")


@query("structural_break", f"WITH k AS (SELECT user_id, row_number() OVER w k, sum(value) OVER w s, sum(value * value) OVER w q, count(*) OVER p n, sum(value) OVER p ts, sum(value * value) OVER p tq FROM events WINDOW w AS ({_W}), p AS (PARTITION BY user_id)), f AS (SELECT user_id, k, tq - ts * ts / n whole, tq - s * s / k - (ts - s) * (ts - s) / nullif(n - k, 0) parts, n FROM k WHERE k >= 10 AND n - k >= 10), g AS (SELECT user_id, k, (whole - parts) / (parts / (n - 2)) f FROM f) SELECT user_id, arg_max(k, f) AS at, round(max(f), 5) AS f FROM g GROUP BY 1")
def _(t):
    d = ts.chow_scan(t("events"), "value", KEY, ORDER)
    return d.select("user_id", F.col("at").cast("long").alias("at"), F.round("f", 5).alias("f"))


for _method, _r in (("min", "rank() OVER w"), ("max", "rank() OVER w + count(*) OVER (PARTITION BY event_type, value) - 1"), ("average", "rank() OVER w + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2"), ("dense", "dense_rank() OVER w"), ("first", "row_number() OVER (PARTITION BY event_type ORDER BY value, event_id)")):

    @query(f"rank_{_method}_by_type", f"SELECT event_id, CAST({_r} AS DOUBLE) AS rank FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)")
    def _(t, method=_method):
        return ts.ranks(t("events").select("event_id", "event_type", "value"), "value", ["event_type"], method, order=["event_id"]).select("event_id", F.col("rank").cast("double").alias("rank"))


# Streams, over the same events as a batch


@query("tumbling_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    w = streaming.windowed(t("events"), "ts", "1 day", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("session_windows", "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) k FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(t):
    return streaming.sessions(t("events"), "ts", "12 hours", ["user_id"], [F.count("*").alias("n")]).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
