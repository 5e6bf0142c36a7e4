"""A quality classifier of supervised subword embeddings, trained here by numpy stochastic gradient descent.

Each word and each of its character n-grams has a learned vector, found by hashing into a fixed number of buckets. A
document is the mean of all their vectors over its whole text; a softmax layer gives the class. A word that stands among
the eight before it also counts as a mark of repetition, itself a hashed token. For scoring, the softmax layer is folded
into the buckets, so that a word's share of the score is computed once and remembered.

Defined cases: a null or empty text gets the score of the bias alone; a very long text is read whole, in a slab of its own; without
labelled rows every score is 0.5; labels that are null are not learnt from; a score of exactly the least one is accepted; repeated
rows score alike; an empty table gives an empty result; other columns, whatever their names, are no input and are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import as_bytes, documents, map_rows, remainder, unused, with_columns, written

#: At most this many labelled rows, of at most so many bytes, are learnt from (those whose ids hash lowest): the driver holds their texts.
MAX_LABELLED, MAX_BYTES = 3000, 64 << 20
BUCKETS, DIM, GRAMS = 1 << 16, 8, (3, 4, 5)
NEAR = 8
REPEAT = b"\x00repeat"


def gram_buckets(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct words: all their buckets (the word's own, then its character n-grams'), and how many each word has."""
    marked = [b"<" + w + b">" for w in found]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    start = np.cumsum(size) - size
    text = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), size)
    room = (start + size)[word] - np.arange(len(text))
    of, bucket = [np.arange(len(marked))], [np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found), np.uint64, len(found)) >> np.uint64(48)]
    for n in GRAMS:
        at = np.flatnonzero(room >= n)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ text[at + i]) * np.uint64(0x100000001B3)
        h *= np.uint64(0x9E3779B97F4A7C15)
        of.append(word[at])
        bucket.append(h >> np.uint64(48))
    of_all, bucket_all = np.concatenate(of), np.concatenate(bucket).astype(np.int64)
    order = np.argsort(of_all, kind="stable")
    return bucket_all[order] % BUCKETS, np.bincount(of_all, minlength=len(found))


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, with a mark for each word that is among the NEAR words before it."""
    found = text.split()
    last: dict[bytes, int] = {}
    marks = 0
    for i, w in enumerate(found):
        if i - last.get(w, -NEAR - 1) <= NEAR:
            marks += 1
        last[w] = i
    return found + [REPEAT] * marks


@dataclass
class Model:
    """gain: the softmax layer's margin of label 1 for each bucket's vector; bias: its own margin."""

    gain: np.ndarray
    bias: float


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    found = tokens(text)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    distinct = sorted(set(found))
    at = {w: i for i, w in enumerate(distinct)}
    times = np.bincount(np.fromiter(map(at.__getitem__, found), np.int64, len(found)), minlength=len(distinct))
    bucket, many = gram_buckets(distinct)
    total = np.bincount(bucket, weights=np.repeat(times, many), minlength=BUCKETS)
    own = np.flatnonzero(total)
    return own, (total[own] / total.sum()).astype(np.float32)


def train(texts: list[bytes], labels: list[int], epochs: int = 6, rate: float = 30.0, seed: int = 7) -> Model:
    """Stochastic gradient descent on the softmax loss, one document a step, in a fixed shuffled order."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    if not texts:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rows = [features(t) for t in texts]
    total = epochs * len(rows)
    for step, i in enumerate(x for _ in range(epochs) for x in rng.permutation(len(rows))):
        own, share = rows[i]
        lr = rate * (1 - step / total)
        mean = share @ vectors[own]
        z = out @ mean + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[labels[i]] -= 1  # the loss's gradient
        back = out.T @ p
        out -= 0.05 * lr * np.outer(p, mean)
        bias -= 0.002 * lr * p
        vectors[own] -= lr * share[:, None] * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, most: int = MAX_BYTES) -> tuple[list[bytes], list[int]]:
    """Whole texts and labels of at most `bound` labelled documents, chosen by the hash of the id; one that would pass `most` bytes in all is left out.

    Of rows of one id the least text and the least label count; they are combined before they move.
    """
    rows = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select(F.col("doc_id").alias("label_id"), "quality", F.xxhash64("doc_id").alias("place"))
    found = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("label_id")).groupBy("place", "label_id", "quality").agg(F.min(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("text"))
    found = written(found, "labelled")
    total, kept = 0, []
    for r in found.select("place", "label_id", F.octet_length("text").alias("size")).orderBy("place", "label_id").collect():  # `bound` rows at most
        if total + r["size"] <= most:
            total += r["size"]
            kept.append(r["label_id"])
    sample = sorted(found.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in kept], "label_id long")), "label_id").select("label_id", "quality", "text").collect())
    return [r["text"].encode() for r in sample], [int(r["quality"] == 1) for r in sample]


def score_of(model: Model):
    """A function from texts to scores that remembers the words' shares."""
    gain, bias = model.gain, model.bias
    known: dict[bytes, tuple[float, int]] = {}

    def of(texts: list[bytes]) -> list[float]:
        if len(known) > 400_000:
            known.clear()
        each = [tokens(t) for t in texts]
        fresh = list({w for found in each for w in found if w not in known})
        if fresh:
            bucket, many = gram_buckets(fresh)
            starts = np.cumsum(many) - many
            known.update(zip(fresh, zip(np.add.reduceat(gain[bucket].astype(np.float64), starts).tolist(), many.tolist(), strict=True), strict=True))
        scores = []
        for found in each:
            pairs = np.array([known[w] for w in found]) if found else np.zeros((0, 2))
            total = pairs.sum(axis=0)
            margin = bias + (total[0] / total[1] if len(found) else 0.0)
            scores.append(float(1 / (1 + np.exp(-np.clip(margin, -500, 500)))))
        return scores

    return of


def _scorer(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)

    def make():
        score = score_of(shared.value)
        return lambda texts: score(as_bytes(texts))

    return make


def scored(docs: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """(id, score) of every row."""
    scorer = _scorer(docs.sparkSession, model)

    def make():
        score = scorer()
        return lambda ids, texts: [ids, score(texts)]

    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id long, score double", make, slab=128)


def accepted(docs: DataFrame, text_col: str, model: Model, least: float = 0.7) -> DataFrame:
    """The rows of docs whose score is at least `least`, with all their columns."""
    scorer = _scorer(docs.sparkSession, model)

    def make():
        score = scorer()
        return lambda texts: [score(texts)]

    (name,) = unused(docs, "__quality")
    return with_columns(docs, [text_col], f"{name} double", make, slab=128).where(F.col(name) >= least).select(*docs.columns)


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the tables' labels, without the held-out rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(remainder("doc_id", 4) != 2)
    return train(*labelled_sample(documents(spark, sf_dir).select("doc_id", "text"), labels))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether it is held out, its score, and the prediction."""
    found = scored(documents(spark, sf_dir), "doc_id", "text", fitted(spark, sf_dir)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES = {}
