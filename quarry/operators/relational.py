"""Slicing, mapping, merging, concatenation, de-duplication, splits and folds.

Row order is never relied on: what needs an order takes `order` columns. A random order is that of a hash of the id, so it
is the same in every run and on every partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators._store import stored

#: Random numbers are whole numbers below this.
MODULUS = 1 << 60


def select_columns(df: DataFrame, columns: Sequence[str | int]) -> DataFrame:
    """Project by name or by position (negative from the end)."""
    names = []
    for c in columns:
        if isinstance(c, int):
            if not -len(df.columns) <= c < len(df.columns):
                raise IndexError(f"no column {c}")
            names.append(df.columns[c])
        elif c in df.columns:
            names.append(c)
        else:
            raise ValueError(f"unknown column {c}")
    return df.select(*names)


def where(df: DataFrame, condition: str | Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Filter by an SQL string, a Column, or a function from the frame to a Column."""
    return df.filter(condition(df) if callable(condition) and not isinstance(condition, Column) else condition)


def dense_number(df: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """A number from 0 in the order of `order`, without one task seeing all rows.

    Rows are sorted into range partitions and written once with their place (partition, and number within it); the partitions'
    sizes, read from the same table, give each one's first number.
    """
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "placed")
    sizes = placed.groupBy(F.shiftright("__m", 33).alias("__p")).agg(F.count("*").alias("__n"))
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # a row a partition
    local = placed.withColumn("__p", F.shiftright("__m", 33)).withColumn("__k", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    return local.join(F.broadcast(starts), "__p").withColumn(name, (F.col("__start") + F.col("__k")).cast("long")).drop("__p", "__m", "__start", "__k")


def running_sums(df: DataFrame, by: str, sums: Mapping[str, str | Column], parts: int = 64) -> DataFrame:
    """Adds for each name the sum of its column over the rows before, in the order of the numeric column `by`; for rows of distinct values.

    Approximate quantiles of the values cut them into `parts` stretches: sums within a stretch, and the sums of the stretches before it.
    """
    x = F.col(by).cast("double")
    at = df.agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], 2000)).first()[0]
    bounds = F.array(*(F.lit(float(v)) for v in sorted(set(at or [0.0]))))
    values = {n: F.col(c) if isinstance(c, str) else c for n, c in sums.items()}
    cut = df.withColumn("__b", F.size(F.filter(bounds, lambda v: v <= x)))
    whole = cut.groupBy("__b").agg(*(F.sum(c).alias(n) for n, c in values.items()))
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = whole.select("__b", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__s_{n}") for n in values))  # `parts` rows
    within = W.partitionBy("__b").orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    summed = cut.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in values.items()})
    return summed.join(F.broadcast(starts), "__b").withColumns({n: F.col(n) + F.col(f"__s_{n}") for n in values}).drop("__b", *(f"__s_{n}" for n in values))


def rows_at(df: DataFrame, order: Sequence[str], start: int | None = None, stop: int | None = None, step: int = 1, positions: Sequence[int] | None = None) -> DataFrame:
    """Rows by position: a slice, or a list of positions (negative from the end)."""
    numbered = dense_number(df, order)
    n = df.count()
    if positions is not None:
        wanted = [p + n if p < 0 else p for p in positions]
        return numbered.where(F.col("row_no").isin(wanted)).drop("row_no")
    lo, hi, step = slice(start, stop, step).indices(n)
    return numbered.where((F.col("row_no") >= lo) & (F.col("row_no") < hi) & ((F.col("row_no") - lo) % step == 0)).drop("row_no")


def map_values(df: DataFrame, column: str, mapping: Mapping, unknown: str = "preserve") -> DataFrame:
    """Values by a small mapping; others are kept (`preserve`) or become null (`null`)."""
    if unknown not in ("preserve", "null"):
        raise ValueError("unknown must be 'preserve' or 'null'")
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    found = F.element_at(table, F.col(column)) if mapping else F.lit(None)
    return df.withColumn(column, F.coalesce(found, F.col(column)) if unknown == "preserve" else found)


def map_columns(df: DataFrame, columns: Sequence[str], f: Callable[[Column], Column]) -> DataFrame:
    """A function of Columns on each of some columns."""
    return df.withColumns({c: f(F.col(c)) for c in columns})


def _renamed(right: DataFrame, taken: Sequence[str], on: Sequence[str], suffix: str) -> DataFrame:
    return right.select(*(F.col(c).alias(c + suffix) if c in taken and c not in on else F.col(c) for c in right.columns))


def merge(frames: Sequence[DataFrame], on: Sequence[str], how: str = "inner", suffix: str = "_y", null_keys_match: bool = False) -> DataFrame:
    """Joins frames one after another on equal keys; a later column whose name is taken gets the suffix."""

    def one(a: DataFrame, b: DataFrame) -> DataFrame:
        b = _renamed(b, a.columns, on, suffix)
        if not null_keys_match:
            return a.join(b, list(on), how)
        keyed = b.select(*(F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in b.columns))
        joined = a.join(keyed, reduce(lambda x, y: x & y, (a[k].eqNullSafe(keyed[f"__r_{k}"]) for k in on)), how)
        return joined.withColumns({k: F.coalesce(k, f"__r_{k}") for k in on}).drop(*(f"__r_{k}" for k in on))

    return reduce(one, frames)


def merge_on_common(frames: Sequence[DataFrame], how: str = "inner") -> DataFrame:
    """Natural join on the columns that all frames share, keys first in sorted order."""
    on = sorted(set.intersection(*(set(f.columns) for f in frames)))
    if not on:
        raise ValueError("the frames share no column")
    out = merge(frames, on, how)
    return out.select(*on, *(c for c in out.columns if c not in on))


def left_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], suffix: str = "_y") -> DataFrame:
    right = _renamed(right, left.columns, [], suffix)
    names = [k + suffix if k in left.columns else k for k in right_on]
    return left.join(right, reduce(lambda a, b: a & b, (left[a] == right[b] for a, b in zip(left_on, names, strict=True))), "left")


def merge_maps(frames: Sequence[DataFrame], on: Sequence[str], column: str) -> DataFrame:
    """Outer join whose map cells are united; of a key in several, the last frame's value stays."""
    out = frames[0].select(*on, F.col(column).alias("__m"))
    for f in frames[1:]:
        out = out.join(f.select(*on, F.col(column).alias("__r")), list(on), "full")
        none = F.create_map().cast(f.schema[column].dataType)
        out = out.withColumns({"__m": F.coalesce("__m", none), "__r": F.coalesce("__r", none)})
        out = out.withColumn("__m", F.map_concat(F.map_filter("__m", lambda k, _: ~F.array_contains(F.map_keys("__r"), k)), "__r")).drop("__r")
    return out.withColumnRenamed("__m", column)


def stack_rows(frames: Sequence[DataFrame], validate: bool = True) -> DataFrame:
    if validate and any(set(f.columns) != set(frames[0].columns) for f in frames):
        raise ValueError("the frames' columns differ")
    return reduce(lambda a, b: a.unionByName(b), frames)


def stack_columns(frames: Sequence[DataFrame], orders: Sequence[Sequence[str]]) -> DataFrame:
    """Frames of equal length side by side, by position in each one's order."""
    numbered = [dense_number(f, o) for f, o in zip(frames, orders, strict=True)]
    return reduce(lambda a, b: a.join(b, "row_no"), numbered).drop("row_no")


def drop_duplicates(df: DataFrame, subset: Sequence[str], order: Sequence[str], keep: str | bool = "first") -> DataFrame:
    """keep: the first or last row of each group in `order`, or none of a group of several (False)."""
    w = W.partitionBy(*subset)
    if keep is False:
        return df.withColumn("__n", F.count("*").over(w)).where("__n = 1").drop("__n")
    by = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    return df.withColumn("__n", F.row_number().over(w.orderBy(*by))).where("__n = 1").drop("__n")


def duplicate_groups(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """(subset, n, extra) of values that occur more than once."""
    return df.groupBy(*subset).agg(F.count("*").alias("n")).where("n > 1").withColumn("extra", F.col("n") - 1)


def pseudo_random(id_col: str, seed: int | Column = 0) -> Column:
    """A fixed number for each id and seed in [0, MODULUS): digits of the MD5 digest of both as text, so the same in any engine, for any id."""
    text = F.concat_ws(":", F.col(id_col).cast("string"), (seed if isinstance(seed, Column) else F.lit(seed)).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def shuffled(df: DataFrame, id_col: str, seed: int = 0, name: str = "row_no") -> DataFrame:
    """Rows numbered in a random order that depends on the ids and the seed alone."""
    return dense_number(df.withColumn("__h", pseudo_random(id_col, seed)), ["__h", id_col], name).drop("__h")


def random_split(df: DataFrame, id_col: str, sizes: Sequence[float], seed: int = 0, name: str = "part") -> DataFrame:
    """A part number: cumulative floor(share * n) of the shuffled order; what is left over is the last part plus one."""
    n = df.count()
    ends = []
    for s in sizes:
        ends.append((ends[-1] if ends else 0) + int(s * n))
    part = reduce(lambda acc, ie: F.when(F.col("__n") < ie[1], ie[0]).otherwise(acc), reversed(list(enumerate(ends))), F.lit(len(ends)))
    return shuffled(df, id_col, seed, "__n").withColumn(name, part).drop("__n")


def stratified_split(df: DataFrame, id_col: str, label: str, share: float, seed: int = 0, at_least_one: bool = True, name: str = "is_test") -> DataFrame:
    """Of each class, floor(share * size) rows (one at least, if asked) in a random order."""
    w = W.partitionBy(label)
    place = F.row_number().over(w.orderBy(pseudo_random(id_col, seed), id_col))
    quota = F.floor(F.count("*").over(w) * share)
    return df.withColumn(name, place <= (F.greatest(quota, F.lit(1)) if at_least_one else quota))


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int, seed: int = 0, contiguous: bool = False, name: str = "fold") -> DataFrame:
    """Folds of each class: the i-th member goes to fold i mod k, or in runs whose first ones are one longer."""
    w = W.partitionBy(label)
    i = F.row_number().over(w.orderBy(pseudo_random(id_col, seed), id_col)) - 1
    if not contiguous:
        return df.withColumn(name, (i % k).cast("int"))
    n = F.count("*").over(w)
    base, extra = F.floor(n / k), n % k
    long = extra * (base + 1)
    fold = F.when(i < long, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - long) / F.greatest(base, F.lit(1))))
    return df.withColumn(name, fold.cast("int"))


def repeated_folds(df: DataFrame, id_col: str, k: int, repeats: int, seed: int = 0) -> DataFrame:
    """Each row once for each repeat, with the fold of that repeat's own order."""
    each = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return each.withColumn("fold", (pseudo_random(id_col, F.lit(seed) + F.col("repeat")) % k).cast("int"))


def time_series_splits(df: DataFrame, order: Sequence[str], n_splits: int, test_size: int, gap: int = 0) -> DataFrame:
    """(split, role, row): expanding training rows, a gap, and a test stretch that moves towards the end."""
    n = df.count()
    numbered = dense_number(df, order)
    each = numbered.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.lit(n) - (F.lit(n_splits) - F.col("split")) * test_size
    role = F.when(F.col("row_no") < start - gap, "train").when((F.col("row_no") >= start) & (F.col("row_no") < start + test_size), "test")
    return each.withColumn("role", role).where("role IS NOT NULL")


def crosstab(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, agg: Column, fill: float = 0.0, normalize: bool = False) -> DataFrame:
    """Pivot with given values; `normalize` divides by the grand total."""
    out = df.groupBy(*rows).pivot(column, list(values)).agg(agg).na.fill(fill)
    if normalize:
        total = out.agg(F.sum(sum((F.col(f"`{v}`") for v in values), F.lit(0)))).first()[0] or 1
        out = out.withColumns({str(v): F.col(f"`{v}`") / total for v in values})
    return out


def lookup(ids: DataFrame, store: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Features of a list of ids; unknown ids keep nulls."""
    return ids.join(store.select(key, *features), key, "left")


def apply_updates_check(old: DataFrame, new: DataFrame, key: str, immutable: Sequence[str], monotonic: Sequence[str]) -> DataFrame:
    """(key, field, rule) of rows whose new version changes an immutable field or lowers a monotonic one."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"))
    bad = [F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.struct(F.lit(c).alias("field"), F.lit("immutable").alias("rule"))) for c in immutable]
    bad += [F.when(F.col(f"n.{c}") < F.col(f"o.{c}"), F.struct(F.lit(c).alias("field"), F.lit("monotonic").alias("rule"))) for c in monotonic]
    return joined.select(F.col(f"o.{key}").alias(key), F.explode(F.array_compact(F.array(*bad))).alias("v")).select(key, "v.field", "v.rule")
