"""LM scoring by prediction by partial matching (PPM) over bytes, pretrained on the corpus, beside a unigram base.

Training counts, over all training documents, every byte with the ORDER bytes before it; a text begins after START bytes and
ends with END, bytes that UTF-8 never holds. These counts make a trie of contexts, and every counted node is in the model. In a
context seen n times with t symbols, a symbol of count c has probability c / (n + t); the rest is the escape, and the next
shorter context is asked with the symbols of the longer one excluded. So a byte's probability depends on its gram (it and
the ORDER bytes before it) alone: a table holds that of every gram of the texts. A trained gram needs the sums of its longest
context only; the grams of held-out texts that training lacks go down the orders by joins. Grams that make a share of COMMON
or more of all bytes to be scored (1 / COMMON grams at most) are broadcast and never shuffled; all others are joined.

The base needs every word's count, without a bound on distinct words: words of a share of FREQUENT or more (1 / FREQUENT words
at most) are broadcast and never shuffled, so no key is hot; all others are joined.

Defined cases: a null text is an empty one and scores its end; a very long text is scored whole; a null id is held out; without training text every byte
costs log10(256); an empty table gives an empty result; repeated rows count and score each; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import as_bytes, documents, map_rows, parts, remainder, tidied, words, written

ORDER = 5
START, END = 0xFE, 0xFF
COMMON = 1e-7
FREQUENT = 1e-5
PIECE = 1 << 20

WORD, GRAM = 0, 1


def grams(texts: list[bytes]) -> np.ndarray:
    """The ORDER + 1 bytes up to each byte of the texts and their ends, in order, as numbers."""
    framed = np.frombuffer(b"".join(bytes([START]) * ORDER + t + bytes([END]) for t in texts), np.uint8).astype(np.uint64)
    key = np.zeros(len(framed), np.uint64)
    for i in range(ORDER + 1):
        key[ORDER:] |= framed[ORDER - i : len(framed) - i] << np.uint64(8 * i)
    size = np.fromiter((len(t) + ORDER + 1 for t in texts), np.int64, len(texts))
    real = np.ones(len(framed), bool)
    starts = np.cumsum(size) - size
    for i in range(ORDER):
        real[starts + i] = False
    return key[real]


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(text[, held]) -> (kind, key, c, h): words and byte grams with their counts; combined in each task before the shuffle.

    Texts that are held out train nothing: h counts their grams, and their words are not counted.
    """
    held_out = F.col("held") if "held" in texts.columns else F.lit(False)

    def run(batches):
        seen: Counter = Counter()
        keys, counts, held = ([], []), ([], []), 0  # of training texts, and of those held out
        schema = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("c", pa.int64()), ("h", pa.int64())])

        def rows(kind: int, names: pa.Array, c: pa.Array, out: bool = False) -> pa.RecordBatch:
            none = pa.array(np.zeros(len(c), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, np.int32)), names, *((none, c) if out else (c, none))], schema=schema)

        def spilled():
            nonlocal held
            if seen:
                yield rows(WORD, pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64()))
            for out in (0, 1):
                if keys[out]:
                    key, count = _summed(keys[out], counts[out])
                    raw = key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - ORDER - 1 :]
                    yield rows(GRAM, pa.FixedSizeBinaryArray.from_buffers(pa.binary(ORDER + 1), len(key), [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary()), pa.array(count), bool(out))
                keys[out].clear()
                counts[out].clear()
            seen.clear()
            held = 0

        for batch in batches:
            for part in parts(batch, 256):
                found, outs = as_bytes(part.column(0)), part.column(1).to_pylist()
                for text, out in zip(found, outs, strict=True):
                    if not out:
                        seen.update(words(text))
                for out in (0, 1):
                    some = [t for t, o in zip(found, outs, strict=True) if o == out]
                    if some:
                        key, count = np.unique(grams(some), return_counts=True)
                        keys[out].append(key)
                        counts[out].append(count)
                        held += len(key)
                if held > 1_500_000:
                    for out in (0, 1):
                        if keys[out]:
                            merged = _summed(keys[out], counts[out])
                            keys[out][:], counts[out][:] = [merged[0]], [merged[1]]
                    held = sum(len(k) for out in keys for k in out)
                if len(seen) > 400_000 or held > 1_000_000:
                    yield from spilled()
        yield from spilled()

    return texts.select(F.col("text").cast("string").alias("text"), held_out.alias("held")).mapInArrow(run, "kind int, key binary, c long, h long").groupBy("kind", "key").agg(F.sum("c").alias("c"), F.sum("h").alias("h"))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def gram_counts(counts: DataFrame) -> DataFrame:
    """(key, c, h): the grams as numbers."""
    return counts.where(F.col("kind") == GRAM).select(F.conv(F.hex("key"), 16, 10).cast("long").alias("key"), "c", "h")


def lower(key: Column, order: int) -> Column:
    """A gram's last byte and the `order` before it."""
    return key.bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))


def contexts(nodes: DataFrame) -> DataFrame:
    """(ctx, n, t, symbols) of nodes (key, c, ...): a row holds 256 symbols at most; grams without training have c = 0."""
    symbol = F.struct(lower(F.col("key"), 0).alias("s"), *(c for c in nodes.columns if c != "key"))
    return nodes.groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("t"), F.collect_list(symbol).alias("symbols"))


def gram_gains(counts: DataFrame) -> DataFrame:
    """(key, uses, gain) of every gram: how often the texts have it, and log10 of its last byte's probability after the others."""
    every = gram_counts(counts)
    trained = lambda: F.filter("symbols", lambda x: x["c"] > 0)
    top = contexts(every).select("ctx", "n", "t", "symbols", trained().alias("seen"))
    each = top.select("ctx", "n", "t", F.when(F.size("seen") < F.size("symbols"), F.transform("seen", lambda x: x["s"])).alias("seen"), F.explode("symbols").alias("x"))
    known = F.col("x.c") > 0
    gain = F.when(known, F.log10(F.col("x.c") / (F.col("n") + F.col("t")))).when(F.col("n") > 0, F.log10(F.col("t") / (F.col("n") + F.col("t")))).otherwise(0.0)
    first = written(each.select((F.shiftleft("ctx", 8) + F.col("x.s")).alias("key"), (F.col("x.c") + F.col("x.h")).alias("uses"), gain.alias("gain"), known.alias("known"), F.when(~known, F.col("seen")).alias("seen")), "gains")
    walk = first.where(~F.col("known"))
    nodes, symbols = every.where("c > 0").select("key", "c"), 0
    for order in range(ORDER - 1, -1, -1):
        nodes = written(nodes.groupBy(lower(F.col("key"), order).alias("key")).agg(F.sum("c").alias("c")), f"nodes{order}")
        there = contexts(nodes)
        if order < 3:  # 256 ** order rows at most
            there = F.broadcast(there)
        at = F.shiftright(lower(F.col("key"), order), 8)
        found = walk.withColumn("ctx", at).join(there, "ctx", "left")
        own = F.get(F.filter("symbols", lambda x: x["s"] == lower(F.col("key"), 0)), F.lit(0))["c"]
        excluded = F.aggregate(F.filter("symbols", lambda x: F.array_contains("seen", x["s"])), F.lit(0).cast("long"), lambda total, x: total + x["c"])
        ask = ~F.col("known") & F.col("n").isNotNull()
        found = found.select("*", own.alias("own"), (F.col("n") + F.col("t") - F.coalesce(excluded, F.lit(0))).alias("whole"))
        walk = found.select(
            "key", "uses", (F.col("gain") + F.when(ask, F.log10(F.coalesce("own", "t") / F.col("whole"))).otherwise(0.0)).alias("gain"),
            (F.col("known") | (ask & F.col("own").isNotNull())).alias("known"), F.when(ask, F.transform("symbols", lambda x: x["s"])).otherwise(F.col("seen")).alias("seen"),
        )
        symbols = nodes.count() if order == 0 else symbols  # 256 at most
    novel = written(walk.select("key", "uses", F.col("gain") - F.when(F.col("known"), 0.0).otherwise(math.log10(max(1, 256 - symbols)))), "novel").toDF("key", "uses", "gain")
    return first.where("known").select("key", "uses", "gain").unionByName(novel)


def kept_nodes(counts: DataFrame) -> tuple[int, np.ndarray]:
    """All training bytes, and all nodes: rows of (order, key, c, n, t), n and t of the node's whole context. The driver holds them: for small corpora."""
    full = gram_counts(counts).where("c > 0")
    total = full.agg(F.sum("c")).first()[0] or 0
    each = full.select("key", "c", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")).select("k", F.col("key").bitwiseAND(F.expr("shiftleft(1L, 8 * (k + 1)) - 1")).alias("key"), "c")
    nodes = each.groupBy("k", "key").agg(F.sum("c").alias("c")).withColumn("ctx", F.shiftright("key", 8))
    sums = nodes.groupBy("k", "ctx").agg(F.sum("c").alias("n"), F.count("*").alias("t"))
    found = nodes.join(sums, ["k", "ctx"]).select("k", "key", "c", "n", "t").toArrow()
    return total, np.stack([found.column(c).to_numpy().astype(np.int64) for c in ("k", "key", "c", "n", "t")])


class Table:
    """A hash table from 64-bit keys to values, looked up by vectors."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, *columns: np.ndarray) -> None:
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, self.EMPTY, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.columns = columns
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == self.EMPTY
            spots, first = np.unique(slot[left[free]], return_index=True)
            winners = left[free][first]
            self.keys[spots], self.at[spots] = keys[winners], winners
            left = np.setdiff1d(left, winners, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.at[slot], -1)
        left = np.flatnonzero((there != keys) & (there != self.EMPTY))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            found[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (there != self.EMPTY)]
        return found


class Ppm:
    """The same model in memory, for small corpora; nodes: rows of (order, key, c, n, t)."""

    def __init__(self, nodes: np.ndarray) -> None:
        self.symbols, self.contexts = [], []
        k, key = nodes[0], nodes[1].astype(np.uint64)
        below: Table | None = None
        for order in range(ORDER + 1):
            own = k == order
            own_key, c, n, t = key[own], nodes[2][own].astype(float), nodes[3][own].astype(float), nodes[4][own].astype(float)
            ctx, first, of = np.unique(own_key >> np.uint64(8), return_index=True, return_inverse=True)
            kept = np.bincount(of, c, len(ctx))
            excluded = np.zeros(len(ctx))
            if below is not None and len(ctx):
                at = below.find(own_key & np.uint64((1 << 8 * order) - 1))
                excluded = np.bincount(of, below.columns[0][at], len(ctx))
            below = Table(own_key, c)
            self.symbols.append(below)
            self.contexts.append(Table(ctx, (n + t)[first], kept, excluded))
        self.rest = max(1, 256 - len(self.symbols[0].columns[0]))

    def log10(self, grams_: np.ndarray) -> np.ndarray:
        """log10 of each gram's last byte after the others."""
        out = np.zeros(len(grams_))
        left = np.arange(len(grams_))
        excluded = np.zeros(len(grams_))
        for order in range(ORDER, -1, -1):
            gram = grams_[left] & np.uint64((1 << 8 * (order + 1)) - 1)
            symbols, contexts = self.symbols[order], self.contexts[order]
            ctx = contexts.find(gram >> np.uint64(8))
            known = ctx >= 0
            if not known.any():
                continue
            rows, ctx = np.flatnonzero(known), ctx[known]
            whole = contexts.columns[0][ctx] - excluded[left[rows]]
            sym = symbols.find(gram[rows])
            hit = sym >= 0
            out[left[rows[hit]]] += np.log10(symbols.columns[0][sym[hit]] / whole[hit])
            miss = ~hit
            out[left[rows[miss]]] += np.log10(1 - (contexts.columns[1][ctx[miss]] - excluded[left[rows[miss]]]) / whole[miss])
            excluded[left[rows[miss]]] = contexts.columns[2][ctx[miss]]
            stays = np.ones(len(left), bool)
            stays[rows[hit]] = False
            # The exclusion of a context is counted in the next shorter one.
            left = left[stays]
        out[left] -= math.log10(self.rest)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end."""
        total = np.zeros(len(texts))
        held: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            held.append(i)
            size += len(t) + 1
            if size >= PIECE or i == len(texts) - 1:
                key = grams([texts[j] for j in held])
                each = np.concatenate([self.log10(key[a : a + PIECE]) for a in range(0, len(key), PIECE)])
                ends = np.cumsum([len(texts[j]) + 1 for j in held])
                total[held] = np.diff(np.concatenate([[0.0], np.cumsum(each)[ends - 1]]))
                held, size = [], 0
        return total


def looked_up(texts: list[bytes], keys: np.ndarray, gains: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of each text the sum of the gains of its grams among `keys` (sorted), and a list of its other grams."""
    key = grams(texts)
    each, inverse = np.unique(key, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, each), max(0, len(keys) - 1))
    hit = keys[at] == each if len(keys) else np.zeros(len(each), bool)
    gain, other = np.where(hit, gains[at] if len(keys) else 0.0, 0.0)[inverse], ~hit[inverse]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    left = np.concatenate([[0], np.cumsum(other)])[starts]
    return np.add.reduceat(gain, starts[:-1]), pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), pa.array(key[other].astype(np.int64)))


_GAINS: dict[str, dict] = {}


def scored(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; the rows not held out are trained on.

    A written table; the others made on the way are deleted.
    """
    with tidied(docs.sparkSession) as keep:
        return keep(_scored(docs, id_col, text_col, held_out), "lm")


def _scored(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"), held_out.alias("held"))
    counts = written(corpus_counts(texts), "counts")
    vocabulary = counts.where(F.col("kind") == WORD).select(F.col("key").alias("word"), "c")
    ends = texts.where(~F.col("held")).count()
    size = vocabulary.agg(F.sum("c"), F.count("*")).first()
    n, v = (size[0] or 0) + ends, size[1] + (1 if ends else 0)
    often = {bytes(r["word"]): r["c"] for r in vocabulary.where(F.col("c") >= max(1.0, FREQUENT * n)).toLocalIterator()}  # 1 / FREQUENT at most
    gained = gram_gains(counts)
    least = max(1.0, COMMON * (counts.where(F.col("kind") == GRAM).agg(F.sum(F.col("c") + F.col("h"))).first()[0] or 0))
    common = gained.where(F.col("uses") >= least).select("key", "gain").toArrow().sort_by("key")  # 1 / COMMON at most
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, common["key"].to_numpy().astype(np.uint64), common["gain"].to_numpy(), often))
    end_gain = math.log10(ends + 1)

    def make():
        name, keys, gains_, frequent = shared.value
        if name not in _GAINS:  # a worker serves many tasks
            _GAINS.clear()
            _GAINS[name] = {w: math.log10(c + 1) for w, c in frequent.items()}
        gain = _GAINS[name]

        def of(uid: pa.Array, ids: pa.Array, held: pa.Array, texts: pa.Array) -> list:
            raw = as_bytes(texts)
            n_tokens, known, base, rare = [], [], [], []
            for t in raw:
                found = words(t)
                gains = [g for g in map(gain.get, found) if g is not None]
                n_tokens.append(len(found) + 1)
                known.append(len(gains) + (ends > 0))
                base.append(sum(gains) + end_gain)
                rare.append([w for w in found if w not in gain] if len(gains) < len(found) else [])
            return [uid, ids, held, n_tokens, known, base, *looked_up(raw, keys, gains_), rare]

        return of

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = "uid long, id long, held_out boolean, n_tokens long, known long, base double, score double, other array<long>, rare array<binary>"
    first = written(map_rows(rows, schema, make, slab=256), "scored")
    seldom = vocabulary.where(F.col("c") < max(1.0, FREQUENT * n))
    rest = first.select("uid", F.explode("rare").alias("word")).join(seldom, "word").groupBy("uid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("gain"))
    others = first.select("uid", F.explode("other").alias("key")).join(gained.where(F.col("uses") < least), "key").groupBy("uid").agg(F.sum("gain").alias("tail"))
    out = first.drop("rare", "other").join(rest, "uid", "left").join(others, "uid", "left")
    base = F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * math.log10(n + v + 1)
    return out.select("id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("tail", F.lit(0.0))).alias("score"))


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the unigram base, and the log10 probability that the PPM model gives the whole text."""
    docs = documents(spark, sf_dir)
    held = F.coalesce(remainder("doc_id", 7) == 2, F.lit(True))
    return scored(docs, "doc_id", "text", held).withColumnRenamed("id", "doc_id")


QUERIES = {"op9_ppm": op9_ppm}
ORACLES = {}
