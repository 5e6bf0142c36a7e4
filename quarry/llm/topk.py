"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's dimensions are cut into SEGMENTS lists; a score is the sum of the partial scores in the lists. Phase one gathers, for
each query, in each task and each list, the k rows of best partial scores; only of these the full scores are computed, and the
k-th best of all is a safe cutoff, as k rows reach it. The cutoffs are broadcast. Phase two: a row can reach the cutoff only if its
partial score reaches cutoff / SEGMENTS in some list, so only such rows are collected. Phase three resolves the full scores of
these and keeps those that reach the cutoff; the k best of them, ties to the smaller id, are the answer.

Queries go in waves of at most WAVE components and WAVE_QUERIES queries, and a wave is broadcast. Rows are read where they lie and
are never shuffled; what moves is k entries for each query and task at most.

Defined cases: vectors that are null, empty, or hold a null, NaN or infinite component take no part; rows of one id are all
candidates, but not of a query of that id; queries of one id share one list of k; vectors of another length than the query's are
no candidates; with fewer than k candidates all are returned; an empty table gives an empty result; other columns are ignored.
Components and scores are held to the range of a long, and are exact within it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm._common import place, tidied, written

SEGMENTS = 2
BLOCK_ROWS, BLOCK_QUERIES = 4096, 512
WAVE, WAVE_QUERIES = 1 << 21, 1 << 14
LEAST, MOST = -(1 << 63), (1 << 63) - 1

def blocks(batch: pa.RecordBatch, most: int):
    """(dim, ids, matrix) of a batch (id, vec): rows of one length, `most` at a time."""
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    size = np.diff(ends)
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        for at in range(0, len(rows), most):
            some = rows[at : at + most]
            yield dim, ids[some], flat[ends[some][:, None] + np.arange(dim)]


def largest(matrix: np.ndarray) -> int:
    return max(abs(int(matrix.max(initial=0))), abs(int(matrix.min(initial=0))))


def exact(q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices as numbers in which the sums of their products are exact: doubles, longs, or Python's integers."""
    bound = largest(q) * largest(rows) * max(1, q.shape[1]) * SEGMENTS
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < MOST else object
    return q.astype(kind), rows.astype(kind)


def lists(q: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The partial scores of every query and row, list by list."""
    cuts = np.array_split(np.arange(q.shape[1]), min(SEGMENTS, q.shape[1]))
    return [q[:, c] @ rows[:, c].T for c in cuts]


def held(score: np.ndarray) -> np.ndarray:
    return np.clip(score, LEAST, MOST).astype(np.int64) if score.dtype == object else score.astype(np.int64)


def resolved(q: np.ndarray, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The full scores of queries a and rows b, pair by pair."""
    out = [held((q[a[i : i + 65536]] * rows[b[i : i + 65536]]).sum(axis=1)) for i in range(0, len(a), 65536)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def heads_of(q: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that lead some list of a query: positions a of queries, and full scores."""
    q, rows = exact(q, rows)
    own = query_ids[:, None] == row_ids
    least = min(k, len(row_ids))
    best = []
    for part in lists(q, rows):
        order = np.argsort(part, axis=1) if part.dtype == object else np.argpartition(np.where(own, LEAST, part), len(row_ids) - least, axis=1)
        best.append(order[:, len(row_ids) - least :])
    lead = np.sort(np.concatenate(best, axis=1), axis=1)
    once = np.ones(lead.shape, bool)
    once[:, 1:] = lead[:, 1:] != lead[:, :-1]  # a row that leads several lists counts once
    once &= ~np.take_along_axis(own, lead, axis=1)
    a, at = np.nonzero(once)
    return a, resolved(q, rows, a, lead[a, at])


def entries_of(q: np.ndarray, query_ids: np.ndarray, cuts: np.ndarray, rows: np.ndarray, row_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs whose partial score reaches its share of the cutoff in some list and whose full score reaches it: a, b, score."""
    q, rows = exact(q, rows)
    parts = lists(q, rows)
    share = (cuts.astype(object) if parts[0].dtype == object else cuts)[:, None]
    near = np.logical_or.reduce([np.asarray(part * len(parts) >= share, bool) for part in parts]) & (query_ids[:, None] != row_ids)
    a, b = np.nonzero(near)
    score = resolved(q, rows, a, b)
    stays = score >= cuts[a]
    return a[stays], b[stays], score[stays]


def best_of(a: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each a's k best scores, ties to the smaller id; in order."""
    order = np.lexsort((ids, ~score, a))
    a = a[order]
    return order[np.arange(len(a)) - np.searchsorted(a, a) < k]


def packed(queries: DataFrame) -> DataFrame:
    """(id, vec) -> (block, n, dim, ids binary, matrix binary): blocks of BLOCK_QUERIES queries of one length at most."""
    schema = pa.schema([("block", pa.string()), ("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())])

    def run(batches):
        for batch in batches:
            for dim, ids, matrix in blocks(batch, max(1, min(BLOCK_QUERIES, WAVE // max(1, batch.column(1).value_lengths().to_numpy().max(initial=1))))):
                yield pa.RecordBatch.from_pydict({"block": [uuid.uuid4().hex], "n": [len(ids)], "dim": [dim], "ids": [ids.astype(np.int64).tobytes()], "matrix": [matrix.astype(np.int64).tobytes()]}, schema=schema)

    return written(queries.select("id", "vec").mapInArrow(run, "block string, n int, dim int, ids binary, matrix binary"), "queries")


def waves(index: list[tuple[str, int, int]]) -> list[list[str]]:
    """index (block, n, dim): blocks put together up to the bounds of a wave."""
    out: list[list[str]] = []
    size = count = 0
    for block, n, dim in sorted(index, key=lambda x: (x[2], x[0])):
        if not out or size + n * dim > WAVE or count + n > WAVE_QUERIES:
            out.append([])
            size = count = 0
        out[-1].append(block)
        size, count = size + n * dim, count + n
    return out


def over_rows(vectors: DataFrame, shared, step: Callable, schema: str) -> DataFrame:
    """step(state, queries, their ids, their cutoffs, rows, row ids) for each block of the broadcast wave and each of a task's rows; gives the states, whose first part is positions of queries."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        wave = [(dim, np.frombuffer(ids, np.int64), np.frombuffer(matrix, np.int64).reshape(-1, dim), cuts) for dim, ids, matrix, cuts in shared.value]
        states: list = [None] * len(wave)
        for batch in batches:
            for dim, row_ids, rows in blocks(batch, BLOCK_ROWS):
                for i, (d, query_ids, q, cuts) in enumerate(wave):
                    if d == dim:
                        states[i] = step(states[i], q, query_ids, cuts, rows, row_ids)
        for state, (_, query_ids, _, _) in zip(states, wave, strict=True):
            if state is not None and len(state[0]):
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[state[0]]), *map(pa.array, state[1:])], names=names)

    return vectors.select("id", "vec").mapInArrow(run, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors (id, vec array<long>), queries (id, vec): (query_id, rank, id, score), k rows for each query. vectors is read twice a wave: a written table."""
    spark = vectors.sparkSession
    q = packed(queries)
    path = place(spark, "entries")
    schema = "query_id long, id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)

    def gather(state, query, query_ids, cuts, rows, row_ids):
        a, score = heads_of(query, query_ids, rows, row_ids, k)
        if state is not None:
            a, score = np.concatenate([state[0], a]), np.concatenate([state[1], score])
        kept = best_of(a, np.zeros(len(a), np.int64), score, k)
        return a[kept], score[kept]

    def collect(state, query, query_ids, cuts, rows, row_ids):
        a, b, score = entries_of(query, query_ids, cuts, rows, row_ids)
        ids = row_ids[b]
        if state is not None:
            a, ids, score = np.concatenate([state[0], a]), np.concatenate([state[1], ids]), np.concatenate([state[2], score])
        kept = best_of(a, ids, score, k)
        return a[kept], ids[kept], score[kept]

    for names in waves([tuple(r) for r in q.select("block", "n", "dim").collect()]):  # one row for some hundred queries
        wave = q.where(F.col("block").isin(names)).select("dim", "ids", "matrix").collect()  # bounded by WAVE and WAVE_QUERIES
        first = spark.sparkContext.broadcast([(r["dim"], bytes(r["ids"]), bytes(r["matrix"]), None) for r in wave])
        gathered = over_rows(vectors, first, gather, "query_id long, score long")
        # The k-th best of all heads; a query with fewer than k of them has no cutoff.
        nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))
        cutoff = {r["query_id"]: r["score"] for r in gathered.withColumn("nth", nth).where(F.col("nth") == k).collect()}
        cuts = [np.array([cutoff.get(i, LEAST) for i in np.frombuffer(bytes(r["ids"]), np.int64).tolist()], np.int64) for r in wave]
        second = spark.sparkContext.broadcast([(r["dim"], bytes(r["ids"]), bytes(r["matrix"]), c) for r, c in zip(wave, cuts, strict=True)])
        over_rows(vectors, second, collect, schema).write.mode("append").parquet(path)
        first.unpersist()
        second.unpersist()
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def scaled(table: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """(id, vec): floor(scale * x) of the vectors that have finite components only."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.size(x) > 0
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return table.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & fine & ok).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("vec"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of each query (vec_id divisible by 20), by the integer inner product."""
    with tidied(spark) as keep:
        vectors = written(scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"), "vectors")
        found = top_k(vectors, vectors.where("id % 20 = 0"), 20)
        return keep(found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"), "top")


QUERIES = {"op3_topk": op3_topk}
ORACLES = {
    "op3_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
}
