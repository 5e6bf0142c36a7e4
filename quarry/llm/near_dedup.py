"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Circulant MinHash takes two permutations of [0, 2**32): `sigma` spreads a shingle's hash, and `pi`, circularly shifted by
k, gives coordinate k: min over the set of pi(sigma(s) - k mod 2**32). Bands of coordinates give buckets. Documents of equal
shingle sets form one class and take part once. In each bucket all classes are compared with the smallest one first; what
then still lies in one bucket but in several components is compared across components, so that no candidate pair that could
join two components is left out, while pairs inside a component are never made. Links are confirmed on the full sets.

Defined cases: a text without words (or null) links with nothing; rows of one id count as one document; a null id takes part
in no link; a very long text is a slab of its own and its set is whole; an empty table gives an empty result; other columns, whatever
their names, are ignored, and kept by one_of_each. Ties do not arise: the smallest id names a component. Buckets below WIDE are searched
pair by pair, those above it by prefixes that miss no link: both ways find every link within a bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm._common import WordHash, as_bytes, documents, map_rows, mix64, shingles, tidied, unused, words, written
from quarry.llm.graph import components

#: 30 bands of 5 coordinates: a pair of Jaccard 0.8 shares no bucket with probability 0.672 ** 30 = 7e-6.
BANDS, ROWS = 30, 5
#: A class in more comparisons than this is copied to several tasks.
FAN = 256
#: A bucket with more pairs across its components than this is searched by rare-first prefixes of its sets.
WIDE = 4_000_000


def _mix32(x: np.ndarray, spare: np.ndarray) -> None:
    """A permutation of the 32-bit numbers, in place."""
    for shift, factor in ((16, 0x21F0AAAD), (15, 0xD35A2D97)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(15), out=spare)
    np.bitwise_xor(x, spare, out=x)


def signature(found: np.ndarray, size: int, block: int = 512) -> np.ndarray:
    """Circulant MinHash of 64-bit shingle hashes: `size` coordinates."""
    sigma = (mix64(found ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32)
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sigma), block):
        x = sigma[at : at + block, None] - shifts
        _mix32(x, np.empty_like(x))
        np.minimum(least, x.min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket key for each band; the band's number is part of it."""
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig.reshape(bands, rows)[:, r])
    return key.view(np.int64)


def bitmap(found: np.ndarray) -> np.ndarray:
    """A bit for each element, at its last bits' place; a power of two of 64-bit words, at least four bits an element."""
    size = 1 << max(2, int(np.ceil(np.log2(len(found) / 16))))
    bits = np.zeros(size * 64, np.uint8)
    bits[(found & np.uint64(size * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether n (set size) and bits of x and y leave room for the link: no pair that reaches `percent` is turned away.

    A bit of one bitmap alone is an element of one set alone, and of |x| + |y| elements at most the share (100 - percent) / (100 + percent)
    may be in one set alone. The larger bitmap is folded to the smaller one's length.
    """
    a, b = F.col(f"{x}.bits"), F.col(f"{y}.bits")
    both = lambda p, q: p.bitwiseOR(q)
    fold = lambda p, q: F.when(F.size(p) > F.size(q), F.zip_with(F.slice(p, F.lit(1), F.size(q)), F.slice(p, F.size(q) + 1, F.size(q)), both)).otherwise(p)
    alone = F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    # Sizes whose ratio allows the link differ by less than twice, so one fold is enough; beyond it the sizes settle it.
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (alone * (100 + percent) <= (n + m) * (100 - percent))


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, set_key, bands, bits): set_key is a digest of the whole shingle set, null for an empty one."""

    def make():
        hashes = WordHash()

        def of(ids: pa.Array, texts: pa.Array) -> list:
            out = []
            known: dict[bytes, tuple] = {}
            for text in as_bytes(texts):
                if text not in known:
                    found = shingles(hashes.of(words(text)), n)
                    key = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    known[text] = (len(found), key, band_keys(signature(found, bands * rows), bands, rows), bitmap(found)) if len(found) else (0, None, None, None)
                out.append(known[text])
            return [ids, *([row[i] for row in out] for i in range(4))]

        return of

    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id long, n_shingles long, set_key binary, bands array<long>, bits array<long>", make)


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, text) -> (id, set): the whole set of shingle hashes."""

    def make():
        hashes = WordHash()
        return lambda ids, texts: [ids, [shingles(hashes.of(words(t)), n).view(np.int64) for t in as_bytes(texts)]]

    return map_rows(docs.select("id", "text"), "id long, set array<long>", make, slab=128)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) -> those with 100 * intersection >= percent * union. The smaller id of a pair may be in very many: it is copied to as many tasks as it needs."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("parts"))
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")).join(degree, "a").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(degree, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).drop("parts")
    both = right.join(left.drop("parts"), ["a", "part"])
    common = F.size(F.array_intersect("set_a", "set_b"))
    sizes = F.size("set_a") + F.size("set_b")
    return both.where(F.least(F.size("set_a"), F.size("set_b")) * 100 >= F.greatest(F.size("set_a"), F.size("set_b")) * percent).where(common * 100 >= (sizes - common) * percent).select("a", "b")


def _across(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """rows (key, node, component, n, bits) -> pairs of nodes of one key and of two components that may be linked.

    The key's largest component stands on one side only, so that its many rows are never held against each other.
    """
    sizes = rows.groupBy(key, "component").agg(F.count("*").alias("size"))
    big = sizes.groupBy(key).agg(F.max(F.struct("size", "component"))["component"].alias("big"), F.count("*").alias("kinds"), F.ceil(F.sum("size") / FAN).alias("parts")).where("kinds > 1").drop("kinds")
    labelled = rows.join(written(big, "big"), key)
    # A large key is dealt over `parts` tasks: one side by node, the other, without the largest component, copied to each.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    x = labelled.where("component != big").withColumn("part", every).alias("x")
    y = labelled.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("y")
    near = (
        (F.col("x.component") != F.col("y.component"))
        & ((F.col("y.component") == F.col("y.big")) | (F.col("x.node") < F.col("y.node")))
        & may_link("x", "y", percent)
    )
    met = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.part") == F.col("y.part")) & near)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _rare_prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of wide buckets -> pairs across components that share an element among the rarest of both sets.

    A set of n elements that reaches `percent` with another one shares an element with it among the n - ceil(percent * n / 100) + 1
    first, in any common order; here elements in fewer sets come first.
    """
    nodes = members.select("node", "component", "bits").dropDuplicates(["node"])
    each = nodes.join(sets, nodes["node"] == sets["id"]).select("node", "component", F.size("set").alias("n"), F.explode("set").alias("e"))
    each = written(each, "elements")
    rarity = each.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    # An element of one set alone meets no other: it takes its place in the order but gives no pair.
    ranked = each.join(rarity, "e", "left").withColumn("place", F.row_number().over(W.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "e")))
    prefix = ranked.where(F.col("df").isNotNull() & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).select("node", "component", "n", "e")
    return _across(written(prefix.join(nodes.select("node", "bits"), "node"), "prefixes"), "e", percent)


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of docs; a written table, the others made on the way are deleted."""
    with tidied(docs.sparkSession) as keep:
        return keep(_near_duplicates(docs, id_col, text_col, n, percent), "near")


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    sketch = written(sketches(docs, id_col, text_col, n), "sketches")
    classes = sketch.where("set_key IS NOT NULL AND id IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = written(classes, "classes")
    # Buckets with two classes or more; what is alone in its bucket goes no further.
    each = classes.select("node", F.explode("bands").alias("h"))
    shared = each.groupBy("h").agg(F.count("*").alias("size"), F.min("node").alias("first")).where("size > 1").drop("size")
    # Aggregates on h are written before they are joined, so that a large h can be split between tasks.
    members = written(each.join(written(shared, "shared"), "h"), "members")
    shape = written(classes.select("node", "n", "bits").join(members.select("node").distinct(), "node", "left_semi"), "shapes")
    stars = members.where("first < node").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stars.join(shape.select(F.col("node").alias("b"), "n", "bits").alias("y"), "b").join(shape.select(F.col("node").alias("a"), "n", "bits").alias("x"), "a").where(may_link("x", "y", percent)).select("a", "b")
    pairs = written(pairs, "pairs")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    set_of = lambda p: written(shingle_sets(texts.join(p.select(F.explode(F.array("a", "b")).alias("id")).distinct().hint("shuffle_hash"), "id", "left_semi"), n), "sets")
    links = written(verified(pairs, set_of(pairs), percent), "links")
    found = written(components(links), "components")
    # Buckets that still hold several components: the pairs across them.
    label = members.join(found, "node", "left").select("h", "node", F.coalesce("component", "node").alias("component"))
    each = label.groupBy("h", "component").agg(F.count("*").alias("k"))
    split = each.groupBy("h").agg(F.count("*").alias("kinds"), (F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))).alias("twice")).where("kinds > 1")
    open_ = written(label.join(written(split.select("h", "twice"), "split"), "h").join(shape, "node"), "open")
    across = _across(open_.where(F.col("twice") <= 2 * WIDE), "h", percent)
    wide = open_.where(F.col("twice") > 2 * WIDE)
    if not wide.isEmpty():
        everyone = wide.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()
        across = across.unionByName(_rare_prefix_pairs(wide, set_of(everyone), percent)).distinct()
    across = written(across.join(pairs, ["a", "b"], "left_anti"), "across")
    more = written(verified(across, set_of(across), percent), "links")
    if not more.isEmpty():
        found = written(components(links.unionByName(more)), "components")
    named = classes.select("set_key", "node").join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    return sketch.join(named, "set_key", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str, text_col: str, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each component its smallest id, once; and all rows without an id.

    Of rows that share an id, that of the least hash of its columns (maps apart) stays, whatever the partitioning; they are made one before they move.
    """
    near = near_duplicates(docs, id_col, text_col, n, percent)
    row, key, kept_id = unused(docs, "__row", "__key", "__kept")
    kept = near.where("id = component_id").select(F.col("id").alias(kept_id)).distinct()
    whole = F.xxhash64(*(docs[c] for c, kind in docs.dtypes if "map<" not in kind))
    once = docs.where(docs[id_col].isNotNull()).groupBy(docs[id_col].cast("long").alias(key)).agg(F.min_by(F.struct(*docs.columns), whole).alias(row))
    stays = once.join(kept.hint("shuffle_hash"), F.col(key) == F.col(kept_id)).select(f"{row}.*")
    return stays.unionByName(docs.where(docs[id_col].isNull()))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the size of its set of 4-word shingles, its component, and whether it stays."""
    found = near_duplicates(documents(spark, sf_dir), "doc_id", "text", n=4)
    kept: Column = F.col("id").eqNullSafe(F.col("component_id"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


QUERIES = {"op2_minhash": op2_minhash}
ORACLES = {}
