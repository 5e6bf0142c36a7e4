"""Near-equal records: comparison of chosen ones, fuzzy duplicates by edit distance, and duplicates by shared values.

Candidates come from exact filters, so no pair that reaches the threshold is missed and no all-pairs join is made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators._store import stored

#: Ids of a list of records with the same values.
LISTED = 1000


def compare(df: DataFrame, id_col: str, ids: Sequence, columns: Sequence[str]) -> DataFrame:
    """(field, same, values): of each column whether the chosen records agree, and their distinct values."""
    rows = df.where(F.col(id_col).isin(list(ids)))
    cell = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in columns))).alias("s")
    t = rows.select(cell).select("s.*").groupBy("field").agg(F.array_sort(F.collect_set("v")).alias("values"), F.count_if(F.col("v").isNull()).alias("nulls"))
    return t.select("field", ((F.size("values") + (F.col("nulls") > 0).cast("int")) <= 1).alias("same"), "values")


def likeness(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; two empty texts are alike, nulls are empty."""
    a, b = F.coalesce(a.cast("string"), F.lit("")), F.coalesce(b.cast("string"), F.lit(""))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches; every round takes the least label of a node's neighbours, and then that label's own."""
    both = stored(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(pairs.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "links")
    label = stored(both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while True:
        near = both.join(label, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("low"))
        lower = label.join(near, F.col("node") == F.col("u")).select("node", F.least("component", "low").alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("to"))
        new = stored(lower.join(jump, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        if new.join(label, ["node", "component"], "left_anti").isEmpty():
            return new
        label = new


def similar_values(values: DataFrame, threshold: float) -> DataFrame:
    """values (v): distinct texts -> (x, y), x < y, whose likeness reaches the threshold (over one half).

    Texts of longer length L within d = floor((1 - threshold) L) edits share L - 1 - 2 d pairs of neighbouring characters at least, and
    L - d characters. Where the first bound says nothing (L up to `short`) characters are asked, beyond it pairs; in either case the
    texts have one in common among the rarest of each: a prefix in order of rarity.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold must lie in (0.5, 1]")
    short = max(length for length in range(1, int(4 / (2 * threshold - 1)) + 2) if length - 1 - 2 * int((1 - threshold) * length + 1e-9) <= 0)
    n = F.length("v")

    def grams(width: int, kind: str, least: Column, where: Column) -> DataFrame:
        """(v, g): the rarest grams of each text; those that a text holds twice are told apart by their number, so that sets count what multisets hold."""
        each = values.where(where).select("v", F.posexplode(F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.substring(F.col("v"), i, F.lit(width)))).alias("p", "g"))
        each = each.withColumn("g", F.concat_ws("|", F.lit(kind), "g", F.row_number().over(W.partitionBy("v", "g").orderBy("p")).cast("string"))).select("v", "g")
        ranked = each.join(each.groupBy("g").agg(F.count("*").alias("df")), "g").withColumn("k", F.row_number().over(W.partitionBy("v").orderBy("df", "g")))
        return ranked.where((F.col("df") > 1) & (F.col("k") <= n - width + 1 - least + 1)).select("v", "g")

    characters = grams(1, "c", F.ceil(n * threshold - 1e-9), n.between(1, short))
    pairs = grams(2, "b", F.greatest(F.lit(1), F.ceil((2 * threshold - 1) * F.greatest(n, F.lit(short + 1)) - 1 - 1e-9)), (n > 1) & (n > (short + 1) * threshold - 1e-9))
    prefix = stored(characters.unionByName(pairs), "grams")
    x, y = prefix.select("g", F.col("v").alias("x")), prefix.select("g", F.col("v").alias("y"))
    near = (F.col("x") < F.col("y")) & (F.least(F.length("x"), F.length("y")) >= threshold * F.greatest(F.length("x"), F.length("y")) - 1e-9)
    return x.join(y, "g").where(near).select("x", "y").distinct().where(likeness(F.col("x"), F.col("y")) >= threshold - 1e-12)


def fuzzy_pairs(df: DataFrame, id_col: str, columns: Sequence[str], threshold: float) -> DataFrame:
    """(a, b, likeness) of records whose mean likeness over the columns reaches the threshold: one column at least does, so candidates come from it."""
    rows = df.select(F.col(id_col).alias("id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(columns)))
    found = None
    for i in range(len(columns)):
        c = f"c{i}"
        values = rows.select(F.col(c).alias("v")).distinct()
        alike = similar_values(values, threshold)
        pairs = alike.unionByName(alike.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(values.select(F.col("v").alias("x"), F.col("v").alias("y")))
        left, right = rows.select(F.col("id").alias("a"), F.col(c).alias("x")), rows.select(F.col("id").alias("b"), F.col(c).alias("y"))
        met = left.join(pairs, "x").join(right, "y").where("a < b").select("a", "b")
        found = met if found is None else found.unionByName(met)
    both = found.distinct()
    for side in "ab":
        both = both.join(rows.select(F.col("id").alias(side), *(F.col(f"c{i}").alias(f"{side}{i}") for i in range(len(columns)))), side)
    mean = sum((likeness(F.col(f"a{i}"), F.col(f"b{i}")) for i in range(len(columns))), F.lit(0.0)) / len(columns)
    return both.select("a", "b", mean.alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)


def copies(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows (id, ...) -> (a, b): the smallest id of the rows that agree in `by`, and each other one; as many links as rows at most."""
    firsts = rows.groupBy(*by).agg(F.min("id").alias("a"))
    return rows.join(firsts, list(by)).where("a < id").select("a", F.col("id").alias("b"))


def fuzzy_groups(df: DataFrame, id_col: str, columns: Sequence[str], threshold: float) -> DataFrame:
    """(id, group): records linked by fuzzy pairs, however many steps apart, under the smallest id. Equal records are compared once, as one."""
    names = [f"c{i}" for i in range(len(columns))]
    rows = df.select(F.col(id_col).alias("id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(columns, names, strict=True)))
    alike = fuzzy_pairs(rows.groupBy(*names).agg(F.min("id").alias("id")), "id", names, threshold).select("a", "b")
    return components(alike.unionByName(copies(rows, names))).select(F.col("node").alias(id_col), F.col("component").alias("group"))


def value_sets(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(id, s): each record's set of values (of any column, as text, nulls apart), unless it is empty."""
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.col(c).cast("string") for c in columns)))))
    return df.select(F.col(id_col).alias("id"), found.alias("s")).where(F.size("s") > 0)


def set_links(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (id, s) -> (x, y, sx, sy, jaccard) of different sets that reach the threshold; x < y are the smallest ids of their records.

    Two sets that reach it share one of the rarest values of each: a prefix of n - ceil(threshold n) + 1 values in order of rarity.
    """
    sets = stored(rows.groupBy("s").agg(F.min("id").alias("first")), "sets")
    each = sets.select("first", F.size("s").alias("n"), F.explode("s").alias("v"))
    ranked = each.join(each.groupBy("v").agg(F.count("*").alias("df")), "v").withColumn("k", F.row_number().over(W.partitionBy("first").orderBy("df", "v")))
    prefix = stored(ranked.where((F.col("df") > 1) & (F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)).select("first", "v"), "prefix")
    x, y = prefix.select("v", F.col("first").alias("x")), prefix.select("v", F.col("first").alias("y"))
    met = x.join(y, "v").where("x < y").select("x", "y").distinct()
    named = met.join(sets.select(F.col("first").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("first").alias("y"), F.col("s").alias("sy")), "y")
    share = F.size(F.array_intersect("sx", "sy")) / F.size(F.array_union("sx", "sy"))
    return named.withColumn("jaccard", share).where(F.col("jaccard") >= threshold - 1e-12)


def value_set_pairs(df: DataFrame, id_col: str, columns: Sequence[str], threshold: float, places: int | None = None) -> DataFrame:
    """(a, b, jaccard) of records whose sets of values reach the threshold. Records of one set are compared once, as one, and their ids kept in lists of some
    LISTED: only lists are joined, and pairs are made from two of them and not moved any more. places: of jaccard, rounded once for two lists."""
    rows = stored(value_sets(df, id_col, columns), "values")
    sets = rows.groupBy("s").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    lists = stored(rows.join(sets, "s").groupBy("first", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / LISTED)).alias("c")).agg(F.collect_list("id").alias("ids")), "lists")
    u, v = lists.select(F.col("first").alias("x"), F.col("c").alias("cx"), F.col("ids").alias("us")), lists.select(F.col("first").alias("y"), F.col("c").alias("cy"), F.col("ids").alias("vs"))
    across = set_links(rows, threshold).select("x", "y", F.round("jaccard", places).alias("jaccard") if places is not None else "jaccard").join(u, "x").join(v, "y").select("us", "vs", "jaccard", F.lit(False).alias("own"))
    within = u.join(v, (F.col("x") == F.col("y")) & (F.col("cx") <= F.col("cy"))).select("us", "vs", F.lit(1.0).alias("jaccard"), (F.col("cx") == F.col("cy")).alias("own"))
    pairs = across.unionByName(within).select(F.explode("us").alias("u"), "vs", "jaccard", "own").select("u", F.explode("vs").alias("v"), "jaccard", "own")
    return pairs.where(~F.col("own") | (F.col("u") < F.col("v"))).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "jaccard")


def drop_similar(df: DataFrame, id_col: str, columns: Sequence[str], threshold: float) -> DataFrame:
    """Rows without a smaller id in the group of rows that their value sets link them with."""
    rows = value_sets(df, id_col, columns)
    links = set_links(rows, threshold).select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(copies(rows, ["s"]))
    others = components(links).where("node <> component").select(F.col("node").alias(id_col))
    return df.join(others, id_col, "left_anti")
