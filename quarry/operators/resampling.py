"""Resampling that looks at neighbours: which majority rows to keep, and where to make minority rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators._store import stored
from quarry.operators.neighbours import nearest
from quarry.operators.relational import dense_number


def near_miss(df: DataFrame, id_col: str, columns: Sequence[str], label: str, minority: object, version: int = 1, k: int = 3) -> DataFrame:
    """All minority rows, and as many majority rows: those of least mean distance to their k nearest (version 1), or k farthest (2), minority rows.

    Version 3: of the majority rows among the k nearest of some minority row, those farthest from their k nearest minority rows.
    """
    few, many = df.where(F.col(label) == F.lit(minority)), df.where(F.col(label) != F.lit(minority))
    quota = few.count()
    if version not in (1, 2, 3):
        raise ValueError("version must be 1, 2 or 3")
    near = nearest(few, many, id_col, columns, k, farthest=version == 2)
    far = near.groupBy("query").agg(F.avg("distance").alias("far"))
    if version == 3:
        shortlist = nearest(many, few, id_col, columns, k).select(F.col("id").alias("query")).distinct()
        far = far.join(shortlist, "query")
    place = F.round("far", 9) * (-1 if version == 3 else 1)  # sums of the same distances in another order are ties
    kept = dense_number(far.select("query", place.alias("far")), ["far", "query"]).where(F.col("row_no") < quota).select(F.col("query").alias(id_col))
    return few.unionByName(many.join(kept, id_col, "left_semi"))


def adaptive_quotas(df: DataFrame, id_col: str, columns: Sequence[str], label: str, minority: object, k: int = 5) -> DataFrame:
    """(query, quota) of each minority row: its share of the rows that the minority lacks, by the share of other classes among its k nearest of all rows."""
    return _quotas(nearest(df, df.where(F.col(label) == F.lit(minority)), id_col, columns, k), df, id_col, label, minority)


def _quotas(near: DataFrame, df: DataFrame, id_col: str, label: str, minority: object) -> DataFrame:
    wanted = df.groupBy(label).count().agg(F.max("count")).first()[0] - df.where(F.col(label) == F.lit(minority)).count()
    near = near.join(df.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("l")), "id")
    share = stored(near.groupBy("query").agg(F.avg((F.col("l") != F.lit(minority)).cast("double")).alias("r")), "shares")
    total = share.agg(F.sum("r").alias("total"))
    return share.crossJoin(F.broadcast(total)).select("query", F.when(F.col("total") > 0, F.round(F.col("r") / F.col("total") * wanted)).otherwise(0).cast("long").alias("quota"))


def _between(pick: DataFrame, few: DataFrame, others: DataFrame, id_col: str, columns: Sequence[str], label: str, minority: object, place: Column) -> DataFrame:
    """pick (query, id, ...): rows made on the way from a row to its neighbour, at a place fixed by the ids."""
    a = few.select(F.col(id_col).cast("long").alias("query"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = others.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).alias(f"b_{c}") for c in columns))
    made = pick.join(a, "query").join(b, "id")
    return made.select(F.col("query").alias("source"), *((F.col(f"a_{c}") + place * (F.col(f"b_{c}") - F.col(f"a_{c}"))).alias(c) for c in columns), F.lit(minority).alias(label))


def adasyn(df: DataFrame, id_col: str, columns: Sequence[str], label: str, minority: object, k: int = 5) -> DataFrame:
    """(source, columns, label): each minority row gives its quota of rows, on the way to its nearest rows of all classes in turn."""
    few = df.where(F.col(label) == F.lit(minority))
    near = stored(nearest(df, few, id_col, columns, k).select("query", "id", "rank"), "near")
    quotas = stored(_quotas(near, df, id_col, label, minority).where("quota > 0"), "quotas")
    each = quotas.select("query", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("i"))
    size = near.groupBy("query").agg(F.max("rank").alias("n"))
    pick = each.join(size, "query").withColumn("rank", (F.col("i") % F.col("n") + 1).cast("int")).join(near, ["query", "rank"])
    return _between(pick, few, df, id_col, columns, label, minority, F.pmod(F.xxhash64("query", "id", "i"), F.lit(1_000_003)) / 1_000_003)


def border_kinds(df: DataFrame, id_col: str, columns: Sequence[str], label: str, minority: object, m: int = 10) -> DataFrame:
    """(query, kind) of minority rows by the others among their m nearest: `noise` if all are, `danger` if half or more, else `safe`."""
    few = df.where(F.col(label) == F.lit(minority))
    near = nearest(df, few, id_col, columns, m).join(df.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("l")), "id")
    share = near.groupBy("query").agg(F.avg((F.col("l") != F.lit(minority)).cast("double")).alias("r"))
    return share.select("query", F.when(F.col("r") >= 1, "noise").when(F.col("r") >= 0.5, "danger").otherwise("safe").alias("kind"))


def borderline_smote(df: DataFrame, id_col: str, columns: Sequence[str], label: str, minority: object, k: int = 5, m: int = 10) -> DataFrame:
    """(source, columns, label): a row between each minority row in danger and one of its k nearest of the class."""
    few = df.where(F.col(label) == F.lit(minority))
    danger = border_kinds(df, id_col, columns, label, minority, m).where("kind = 'danger'").select(F.col("query").alias("d"))
    near = nearest(few, few.join(danger, F.col(id_col).cast("long") == F.col("d"), "left_semi"), id_col, columns, k)
    pick = near.withColumn("n", F.max("rank").over(W.partitionBy("query"))).where(F.col("rank") == F.pmod(F.xxhash64("query"), F.col("n")) + 1).select("query", "id")
    return _between(pick, few, few, id_col, columns, label, minority, F.pmod(F.xxhash64("query", "id"), F.lit(1_000_003)) / 1_000_003)


def condensed(df: DataFrame, id_col: str, columns: Sequence[str], label: str, minority: object, seeds: int = 1, rounds: int = 30) -> DataFrame:
    """The minority, `seeds` first rows of the others, and, round by round, the rows whose nearest kept row is of another class, until none is."""
    from quarry.operators.relational import pseudo_random

    rows = df.withColumn("__i", F.col(id_col).cast("long"))
    first = rows.where(F.col(label) != F.lit(minority)).orderBy(pseudo_random(id_col), id_col).limit(seeds)
    kept = stored(rows.where(F.col(label) == F.lit(minority)).unionByName(first).select("__i"), "kept")
    for _ in range(rounds):
        store, rest = rows.join(kept, "__i", "left_semi"), rows.join(kept, "__i", "left_anti")
        near = nearest(store, rest, id_col, columns, 1).select("query", F.col("id").alias("__i"))
        named = near.join(rows.select("__i", F.col(label).alias("own")), "__i").select(F.col("query").alias("__i"), "own")
        wrong = stored(rest.join(named, "__i").where(F.col(label) != F.col("own")).select("__i"), "wrong")
        if wrong.isEmpty():
            break
        kept = stored(kept.unionByName(wrong), "kept")
    return rows.join(kept, "__i", "left_semi").drop("__i")


def relief(df: DataFrame, id_col: str, columns: Sequence[str], label: str, k: int = 5, share: float = 1.0) -> DataFrame:
    """(name, weight): how much farther, in the column's range, a row lies from its k nearest of other classes than from its k nearest of its own.

    share: which part of the rows, by the hash of the id, is asked; all rows are neighbours.
    """
    from quarry.operators.relational import MODULUS, pseudo_random

    ends = df.agg(*(F.min(c).cast("double") for c in columns), *(F.max(c).cast("double") for c in columns)).first()
    spans = [max(1e-300, b - a) for a, b in zip(ends[: len(columns)], ends[len(columns) :], strict=True)]
    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(label).alias("l"), *((F.col(c) / s).alias(c) for c, s in zip(columns, spans, strict=True)))
    found = None
    for value in [r[0] for r in df.select(label).distinct().collect()]:
        asked = rows.where((F.col("l") == F.lit(value)) & (pseudo_random("i") < int(share * MODULUS)))
        for same in (True, False):
            pool = rows.where((F.col("l") == F.lit(value)) if same else (F.col("l") != F.lit(value)))
            near = nearest(pool, asked, "i", columns, k).select("query", "id", F.lit(-1.0 if same else 1.0).alias("sign"))
            found = near if found is None else found.unionByName(near)
    a, b = rows.select(F.col("i").alias("query"), *(F.col(c).alias(f"a_{c}") for c in columns)), rows.select(F.col("i").alias("id"), *(F.col(c).alias(f"b_{c}") for c in columns))
    t = found.join(a, "query").join(b, "id")
    row = t.agg(*(F.avg(F.when(F.col("sign") > 0, F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")))) - F.avg(F.when(F.col("sign") < 0, F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")))) for c in columns)).first()
    return df.sparkSession.createDataFrame([(c, v) for c, v in zip(columns, row, strict=True)], "name string, weight double")
