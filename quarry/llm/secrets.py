"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of its text). The ledger, a Parquet table, names the
(blob, rule version) pairs already scanned and what was found; a scan reads only pairs that it lacks, one text per
blob, and findings are joined back to all paths and versions that hold the blob. The rule version is a digest of the rules, so that
changed rules scan anew.

Defined cases: a null text is an empty one; a very long text is scanned whole, and its matches are rows, whose places a running sum
gives; an empty table gives an empty result; rows that repeat are rows of their own with the same findings; a ledger that holds a
pair twice counts it once; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm._common import documents, shared_dir, written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose group has at least `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = True


#: The kinds in their order, their patterns and least lengths.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("vendor", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{24,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, base=False),
)
SPAN = "struct<kind:string,rank:int,start:long,end:long>"


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()[:16]


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """One rule's matches, each with the lengths of the gap before it, of itself and of its group: pieces between matches and matches alternate."""
    found = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part"),
    )
    each = F.transform(found, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["part"]).alias("part")))
    return F.when(text.rlike(rule.pattern), F.filter(each, lambda x: x["hit"].isNotNull())).otherwise(F.array().cast("array<struct<rank:int,i:int,gap:int,hit:int,part:int>>"))


def scanned(fresh: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) -> (blob, spans), a row for each blob: all rules' spans in code points, by start and then by the rules' order.

    Lengths alone leave the row of a text. Rows of one blob, whose matches are the same, are made one before they move.
    """
    found = F.concat(*(matches(F.col("text"), r, i) for i, r in enumerate(rules)))
    each = fresh.select("blob", F.explode_outer(found).alias("x")).select("blob", "x.*")
    once = each.groupBy("blob", "rank", "i").agg(*(F.first(c).alias(c) for c in ("gap", "hit", "part")))
    end = F.sum((F.col("gap") + F.col("hit")).cast("long")).over(W.partitionBy("blob", "rank").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    kind, least = (F.element_at(F.array(*(F.lit(getattr(r, c)) for r in rules)), F.col("rank") + 1) for c in ("kind", "least"))
    span = F.when(F.col("part") >= least, F.struct((F.col("end") - F.col("hit")).alias("start"), "rank", "end", kind.alias("kind")))
    placed = once.withColumn("end", end).groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return placed.withColumn("spans", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"))))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = f"blob binary, rule_version string, spans array<{SPAN}>"
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_versions(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions (path string, version, text) -> the same rows without text, with blob and spans; the ledger grows by what was unseen."""
    spark, rules_now = versions.sparkSession, rule_version(rules)
    address = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    texts = versions.select(F.coalesce(F.col("path"), F.lit("")).alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = written(versions.select("path", "version", address.alias("blob")), "versions")
    seen = read_ledger(spark, ledger_path).where(F.col("rule_version") == rules_now).select("blob")
    # One path for each blob that the ledger lacks; combined before the shuffle, so a blob of many copies is one row a task.
    unseen = rows.groupBy("blob").agg(F.min(F.coalesce("path", F.lit(""))).alias("path")).join(seen, "blob", "left_anti")
    fresh = texts.join(unseen.hint("shuffle_hash"), "path").where(F.unhex(F.sha2("text", 256)) == F.col("blob"))
    scanned(fresh, rules).select("blob", F.lit(rules_now).alias("rule_version"), "spans").write.mode("append").parquet(ledger_path)
    known = read_ledger(spark, ledger_path).where((F.col("rule_version") == rules_now) & (F.size("spans") > 0))
    found = written(known.groupBy("blob").agg(F.first("spans").alias("spans")), "findings")
    # Nothing but the exchange stands before this join, so that the rows of a blob of very many copies are split between tasks.
    return rows.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans.

    The ledger lies where spark.quarry.secrets.ledger says, and stays; where that is unset, it is a new one.
    """
    ledger = spark.conf.get("spark.quarry.secrets.ledger", None) or f"{shared_dir(spark)}/quarry/ledger-{uuid.uuid4().hex}"
    versions = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("version"), "text")
    out = scan_versions(versions, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < sum(r.base for r in RULES))
    return out.select(
        F.col("version").alias("doc_id"),
        *(count(r.kind).alias(f"n_{r.kind}") for r in RULES if r.base),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    def found(i: int, r: Rule) -> str:
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        return f"""
      SELECT doc_id, '{r.kind}' AS kind, {i} AS rank, unnest(hits) AS hit, unnest(parts) AS part, gaps, hits, generate_subscripts(hits, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(t, {pattern}, 0) AS hits, regexp_extract_all(t, {pattern}, {r.group}) AS parts, regexp_split_to_array(t, {pattern}) AS gaps FROM d)"""

    least = " OR ".join(f"(kind = '{r.kind}' AND length(part) >= {r.least})" for r in RULES)
    n = sum(r.base for r in RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(found(i, r) for i, r in enumerate(RULES))}),
s AS (
  SELECT doc_id, kind, rank,
    CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS b, length(hit) AS n
  FROM m WHERE {least}),
g AS (
  SELECT doc_id, {counts},
    string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, rank) FILTER (rank < {n}) AS base,
    string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, rank) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES = {"op1_secret_scan": _oracle()}
