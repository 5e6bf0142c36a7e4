"""Missing values, typed validation and text repair."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.quantiles import exact_quantiles


def null_if_nan(df: DataFrame) -> DataFrame:
    """NaN in floating columns, and the text 'nan', become null: done once at the door."""
    return df.withColumns({
        c: F.when(~F.isnan(c), F.col(c)) if t in ("double", "float") else F.when(F.lower(c) != "nan", F.col(c)) for c, t in df.dtypes if t in ("double", "float", "string")
    })


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None, max_share: float = 0.0) -> DataFrame:
    """Rows whose share of nulls is at most `max_share`."""
    cols = list(columns or df.columns)
    missing = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.where(missing <= F.lit(max_share * len(cols)))


def drop_null_columns(df: DataFrame, max_share: float) -> DataFrame:
    """Columns whose share of nulls is at most `max_share`; one pass."""
    row = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if (row[c] or 0.0) <= max_share))


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, missing, share) of each column."""
    cell = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("missing")) for c in columns)))
    t = df.agg(F.count("*").alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return t.select("__n", cell.alias("s")).select("s.name", "s.missing", (F.col("s.missing") / F.col("__n")).alias("share"))


def missingness_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of the null indicators."""
    from quarry.operators.statistics import correlation_pairs

    return correlation_pairs(df.select(*(F.col(c).isNull().cast("double").alias(c) for c in columns)), columns)


def fit_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return df.agg(*(F.avg(c).alias(c) for c in columns)).first().asDict()


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """The most frequent value of each column; of equally frequent ones the smallest."""
    out = {}
    for c in columns:
        row = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).agg(F.min_by(c, F.struct(-F.col("n"), F.col(c)))).first()
        out[c] = row[0]
    return out


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None})


def fill_along(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], direction: str = "forward", limit: int | None = None, name: str | None = None) -> DataFrame:
    """Last known value before a gap (`forward`), next after it (`backward`), or forward and then backward (`both`); at most `limit` steps."""
    back = W.partitionBy(*by).orderBy(*order).rowsBetween(-limit if limit else W.unboundedPreceding, 0)
    ahead = W.partitionBy(*by).orderBy(*order).rowsBetween(0, limit if limit else W.unboundedFollowing)
    f, b = F.last(column, ignorenulls=True).over(back), F.first(column, ignorenulls=True).over(ahead)
    return df.withColumn(name or column, {"forward": f, "backward": b, "both": F.coalesce(f, b)}[direction])


def fill_linear(df: DataFrame, column: str, by: Sequence[str], order: str, name: str | None = None) -> DataFrame:
    """On the line between the known neighbours, by a numeric order column; ends stay null."""
    w = W.partitionBy(*by).orderBy(order)
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col(column).isNotNull(), F.col(order).cast("double"))
    x0, x1 = F.last(at, ignorenulls=True).over(before), F.first(at, ignorenulls=True).over(after)
    y0, y1 = F.last(column, ignorenulls=True).over(before), F.first(column, ignorenulls=True).over(after)
    line = y0 + (y1 - y0) * (F.col(order) - x0) / F.when(x1 != x0, x1 - x0)
    return df.withColumn(name or column, F.coalesce(F.col(column), line))


def grubbs(df: DataFrame, column: str) -> DataFrame:
    """(n, extreme, g): the value furthest from the mean, in sample deviations."""
    t = df.agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.stddev_samp(column).alias("s"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    high = F.col("hi") - F.col("m") >= F.col("m") - F.col("lo")
    extreme = F.when(high, F.col("hi")).otherwise(F.col("lo"))
    return t.select("n", extreme.alias("extreme"), (F.abs(extreme - F.col("m")) / F.col("s")).alias("g"))


def chauvenet(df: DataFrame, column: str, name: str = "is_outlier") -> DataFrame:
    """Flags values so far out that fewer than half a row is expected: 2 (1 - Phi(z)) < 1 / (2 n)."""
    from quarry.functions.special import norm_cdf

    n, m, s = df.agg(F.count(column), F.avg(column), F.stddev_pop(column)).first()
    z = F.abs(F.col(column) - m) / (s or 1e-10)
    return df.withColumn(name, F.coalesce(2 * (1 - norm_cdf(z)) < 1 / (2 * n), F.lit(False)))


# Text


def title_case(x: Column) -> Column:
    return F.initcap(x)


def without_special(x: Column, keep: str = "") -> Column:
    """Only ASCII letters, digits, white space and `keep` stay."""
    return F.regexp_replace(x, "[^A-Za-z0-9\\s" + re.sub(r"([\\\]\[^-])", r"\\\1", keep) + "]", "")


def invalid_characters(x: Column, allowed: str) -> Column:
    """How many characters are outside an allowed class."""
    return F.length(x) - F.length(F.regexp_replace(x, f"[^{allowed}]", ""))


def replaced_words(x: Column, mapping: Mapping[str, str]) -> Column:
    """Whole words in any case, longest first; a word in capitals or with a capital keeps that."""
    out = x
    for old in sorted(mapping, key=lambda w: (-len(w), w)):
        new = mapping[old]
        for a, b in dict.fromkeys(((old.upper(), new.upper()), (old.capitalize(), new.capitalize()), (old.lower(), new.lower()))):
            out = F.regexp_replace(out, rf"\b{re.escape(a)}\b", b.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def merge_similar(df: DataFrame, column: str, threshold: float) -> dict[str, str]:
    """Each category to the commonest one that its text resembles (1 - edit distance over length). Runs over all pairs of distinct categories whose lengths allow it."""
    t = df.groupBy(F.col(column).alias("c")).agg(F.count("*").alias("n")).where("c IS NOT NULL")
    a, b = t.alias("a"), t.alias("b")
    longer = F.greatest(F.length("a.c"), F.length("b.c"), F.lit(1))
    alike = 1 - F.levenshtein("a.c", "b.c") / longer
    near = a.join(b, (F.abs(F.length("a.c") - F.length("b.c")) <= (1 - threshold) * longer + 1e-9) & (alike >= threshold))
    best = near.groupBy("a.c").agg(F.max_by("b.c", F.struct("b.n", "b.c")).alias("to"))
    return {r["c"]: r["to"] for r in best.collect()}


# Validation: each rule is a boolean Column that is true for a row that breaks it; a suite is one aggregate.


def out_of_range(x: Column, low: float | None, high: float | None, include_low: bool = True, include_high: bool = True) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (x < low if include_low else x <= low)
    if high is not None:
        bad = bad | (x > high if include_high else x >= high)
    return F.coalesce(bad, F.lit(False))


def not_in_domain(x: Column, allowed: Sequence) -> Column:
    return F.coalesce(~x.isin(*allowed), F.lit(False))


def breaks_pattern(x: Column, pattern: str) -> Column:
    return F.coalesce(~x.rlike(pattern), F.lit(True))


def not_numeric(x: Column) -> Column:
    return x.isNotNull() & x.try_cast("double").isNull()


def not_a_date(x: Column, form: str) -> Column:
    return x.isNotNull() & F.try_to_timestamp(x, F.lit(form)).isNull()


def too_old(x: Column, now: str, hours: float) -> Column:
    return x < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(int(hours)))


#: Fixed value: the shape of an e-mail address.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, broken, checked) of every rule, in one pass."""
    t = df.agg(F.count("*").alias("__n"), *(F.count_if(c).alias(k) for k, c in rules.items()))
    cell = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("broken")) for k in rules)))
    return t.select("__n", cell.alias("s")).select("s.rule", "s.broken", F.col("__n").alias("checked"))


def unique_violations(df: DataFrame, field_sets: Sequence[Sequence[str]]) -> DataFrame:
    """(fields, extra): how many rows repeat each set of fields."""
    parts = [df.groupBy(*fs).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("extra")).select(F.lit("+".join(fs)).alias("fields"), "extra") for fs in field_sets]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_columns(df: DataFrame, required: Sequence[str], allowed: Sequence[str] | None = None) -> dict[str, list[str]]:
    return {"missing": [c for c in required if c not in df.columns], "unexpected": [c for c in df.columns if allowed is not None and c not in allowed]}


def quality_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, completeness, uniqueness, mean, std, median) of numeric columns in one pass."""
    row = df.agg(F.count("*").alias("__n"), *(e.alias(f"{c}|{k}") for c in columns for k, e in (("n", F.count(c)), ("d", F.count_distinct(F.col(c))), ("m", F.avg(c)), ("s", F.stddev_pop(c)), ("q", F.percentile(c, F.lit(0.5))))))
    x = lambda c, k: F.col(f"`{c}|{k}`").cast("double")
    cells = [F.struct(F.lit(c).alias("name"), (x(c, "n") / F.col("__n")).alias("completeness"), (x(c, "d") / x(c, "n")).alias("uniqueness"), x(c, "m").alias("mean"), x(c, "s").alias("std"), x(c, "q").alias("median")) for c in columns]
    return row.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def stability_index(df: DataFrame, value: str, is_reference: Column, bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index over shared equal-width bins; empty shares count as eps."""
    from quarry.operators.binning import digitize, equal_width_edges

    edges = equal_width_edges(df, value, bins)
    t = df.groupBy(digitize(F.col(value), edges).alias("bin")).agg(F.count_if(is_reference).alias("r"), F.count_if(~is_reference).alias("c"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(t, "bin", "left").na.fill(0)
    w = W.partitionBy()
    p, q = F.greatest(F.col("r") / F.sum("r").over(w), F.lit(eps)), F.greatest(F.col("c") / F.sum("c").over(w), F.lit(eps))
    return every.withColumn("part", (q - p) * F.log(q / p)).agg(F.sum("part").alias("psi"))


def quantile_drift(df: DataFrame, value: str, is_reference: Column, quantiles: Sequence[float], threshold: float) -> DataFrame:
    """(q, reference, current, drifted)."""
    t = df.agg(*(F.percentile(F.when(is_reference if r else ~is_reference, F.col(value)), F.lit(q)).alias(f"{'r' if r else 'c'}{i}") for i, q in enumerate(quantiles) for r in (1, 0)))
    cells = F.array(*(F.struct(F.lit(float(q)).alias("q"), F.col(f"r{i}").alias("reference"), F.col(f"c{i}").alias("current")) for i, q in enumerate(quantiles)))
    return t.select(F.explode(cells).alias("s")).select("s.*").withColumn("drifted", F.abs(F.col("current") - F.col("reference")) > threshold)


def csv_faults(lines: DataFrame, column: str, fields: int, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """lines with n_fields and fault: `quotes` where a quote is left open, `fields` where their number is not as asked, else null. Delimiters inside quotes do not count."""
    x = F.coalesce(F.col(column), F.lit(""))
    q = "\\" + quote
    bare = F.regexp_replace(x, f"{q}[^{q}]*{q}", "")
    n = F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1
    fault = F.when(bare.contains(quote), "quotes").when(n != fields, "fields")
    return lines.withColumns({"n_fields": n, "fault": fault})
