"""Byte-level BPE encoding and decoding by recursive queries of DuckDB, one database in each Python worker.

The distinct pre-tokens of a slab of rows become token-position rows: each step of a recursive query unnests the words that still
change, joins neighbouring positions with the merge table (every pair of tokens whose joined bytes are a token, under that
token's rank) and contracts, in each word, the leftmost pair of least rank, until no pair is left. The recursion is keyed by the word,
so that one state of each word is held and no history. Decoding joins ids with the vocabulary and aggregates the bytes in order of
position. Ids of recurring stretches of text are remembered up to a bound. A word of n bytes takes n steps of n rows, so pre-tokens of
over LONG bytes (see the README for the time that they would take) are contracted by a heap instead, with the same result.

Defined cases: a null or empty text has no ids; a very long text is a slab of its own, coded whole, PIECE bytes of distinct pre-tokens
in one recursion; unknown or null ids decode to nothing; an empty table gives an empty result; repeated rows are coded alike;
other columns are ignored. DuckDB never spills: what it holds is bounded by PIECE.
"""

from __future__ import annotations

import hashlib
import heapq

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import documents, map_rows
from quarry.llm.pretokens import STRETCH, Memory, Splitter, public_path, public_pattern, read_ranks

LONG = 1024
PIECE = 1 << 20
REMEMBERED = 600_000

#: The rows of a step are words with the ids left in them; their positions are unnested to be joined with the merge table.
ENCODE = """
WITH RECURSIVE step(w, ids) USING KEY (w) AS (
  SELECT w, ids FROM start
  UNION
  (WITH pair AS (SELECT w, unnest(ids[:-2]) AS t, unnest(ids[2:]) AS next_t, generate_subscripts(ids[2:], 1) AS p FROM step),
   best AS (SELECT w, min((o::BIGINT << 32) | p) AS b FROM pair JOIN merges ON k = (t::BIGINT << 32) | next_t GROUP BY w)
   SELECT w, ids[:(b & 4294967295) - 1] || [(b >> 32)::INT] || ids[(b & 4294967295) + 2:] FROM step JOIN best USING (w))
)
SELECT w, ids FROM step"""

#: Runs lie end to end; a group is a stretch of them of bounded length.
DECODE = "SELECT p // 65536 AS g, string_agg(hex, '' ORDER BY p) AS hex FROM coded JOIN vocabulary USING (t) GROUP BY g ORDER BY g"


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, Splitter(pattern)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.tokens = {i: t for t, i in ranks.items()}
        self.pieces, self.stretches, self.texts = Memory(REMEMBERED // 3), Memory(REMEMBERED), Memory(REMEMBERED)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.size[i] = len(t)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], o) for t, o in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        merges = pa.table({"k": pa.array([k for k, _ in pairs], pa.int64()), "o": pa.array([o for _, o in pairs], pa.int32())})  # noqa: F841
        names = pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in ranks])})  # noqa: F841
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges; CREATE TABLE vocabulary AS SELECT * FROM names")

    def _merge(self, pieces: list[str]) -> None:
        """Puts the ids of pre-tokens, as little-endian unsigned 32-bit integers, into `pieces`."""
        raw = [p.encode() for p in pieces]
        for piece, text in zip(pieces, raw, strict=True):
            if text in self.ranks:  # a pre-token that is a token needs no merges
                self.pieces[piece] = self.ranks[text].to_bytes(4, "little")
            elif len(text) > LONG:
                self.pieces[piece] = np.array(by_heap(text, self.ranks), "<u4").tobytes()
        short = [i for i, text in enumerate(raw) if len(text) <= LONG and text not in self.ranks]
        size = np.fromiter((len(raw[i]) for i in short), np.int64, len(short))
        part = np.cumsum(size) // PIECE
        for k in np.unique(part).tolist():
            some, own = np.array(short, np.int32)[part == k], size[part == k]
            flat = self.byte[np.frombuffer(b"".join(raw[i] for i in some.tolist()), np.uint8)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32)), pa.array(flat))
            self.db.register("start", pa.table({"w": some, "ids": lists}))
            found = self.db.sql(ENCODE).to_arrow_table()
            self.db.unregister("start")
            ids = found["ids"].combine_chunks()
            left, ends = ids.values.to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy() * 4).tolist()
            for w, a, b in zip(found["w"].to_pylist(), ends[:-1], ends[1:], strict=True):
                self.pieces[pieces[w]] = left[a:b]

    def encode(self, texts: list[str]) -> list[list[bytes]]:
        """Of each text the ids of its stretches, in order."""
        cut = [STRETCH.findall(t) for t in texts]
        self.stretches.room()
        self.pieces.room()
        fresh = {s: self.split(s) for s in set().union(*cut) if s not in self.stretches}
        if fresh:
            self._merge([p for p in {p for found in fresh.values() for p in found} if p not in self.pieces])
            self.stretches.update((s, b"".join(map(self.pieces.__getitem__, found))) for s, found in fresh.items())
        return [list(map(self.stretches.__getitem__, found)) for found in cut]

    def decode(self, runs: list[list[bytes]]) -> list[bytes]:
        """Of each list of runs of ids the bytes. Decoding a sequence is decoding its runs, which recur."""
        self.texts.room()
        fresh = [r for r in set().union(*runs) if r not in self.texts]
        if fresh:
            ids = np.frombuffer(b"".join(fresh), "<u4").astype(np.int32)
            coded = pa.table({"p": np.arange(len(ids)), "t": ids})
            self.db.register("coded", coded)
            found = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("coded")
            whole = b"".join(map(bytes.fromhex, found["hex"].to_pylist()))
            ends = np.concatenate([[0], np.cumsum(self.size[ids])])[np.cumsum([len(r) // 4 for r in fresh])].tolist()
            self.texts.update((r, whole[a:b]) for r, a, b in zip(fresh, [0, *ends], ends, strict=False))
        return [b"".join(map(self.texts.__getitem__, found)) for found in runs]


def by_heap(text: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Contracts the leftmost pair of least rank until none is left."""
    part: list[bytes | None] = [text[i : i + 1] for i in range(len(text))]
    after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
    heap = [(ranks[p], i, p) for i in range(len(text) - 1) if (p := text[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j >= len(text) or part[i] + part[j] != joined:
            continue
        part[i], part[j], after[i] = joined, None, after[j]
        if after[i] < len(text):
            before[after[i]] = i
            if (p := joined + part[after[i]]) in ranks:
                heapq.heappush(heap, (ranks[p], i, p))
        if before[i] >= 0 and (p := part[before[i]] + joined) in ranks:
            heapq.heappush(heap, (ranks[p], before[i], p))
    return [ranks[p] for p in part if p is not None]


_CODECS: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """This worker's codec for a broadcast (ranks, pattern, key); one is kept, as workers serve many tasks."""
    ranks, pattern, key = shared.value
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _shared(spark: SparkSession, path: str | None, pattern: str | None):
    path, pattern = path or public_path("byte_bpe_multi_50k.tiktoken"), pattern or public_pattern()
    return spark.sparkContext.broadcast((read_ranks(path), pattern, f"{path} {pattern}"))


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids): each text's token ids. path: a rank file, read on the driver."""
    shared = _shared(docs.sparkSession, path, pattern)

    def make():
        codec = _codec(shared)
        return lambda ids, texts: [ids, [np.frombuffer(b"".join(r), "<u4").astype(np.int32) for r in codec.encode([t or "" for t in texts.to_pylist()])]]

    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id long, ids array<int>", make)


def decoded(coded: DataFrame, id_col: str, ids_col: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, bytes): what each list of ids stands for."""
    shared = _shared(coded.sparkSession, path, pattern)

    def make():
        codec = _codec(shared)
        return lambda ids, lists: [ids, codec.decode([[np.array([x for x in row or [] if x is not None and x in codec.tokens], "<u4").tobytes()] for row in lists.to_pylist()])]

    return map_rows(coded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")), "id long, bytes binary", make)


def round_trip(docs: DataFrame, id_col: str, text_col: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to."""
    shared = _shared(docs.sparkSession, path, pattern)

    def make():
        codec = _codec(shared)

        def of(ids: pa.Array, texts: pa.Array) -> list:
            runs = codec.encode([t or "" for t in texts.to_pylist()])
            joined = [b"".join(r) for r in runs]
            return [ids, [len(x) // 4 for x in joined], [hashlib.sha256(x).hexdigest() for x in joined], [hashlib.sha256(x).hexdigest() for x in codec.decode(runs)]]

        return of

    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make, slab=1024)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its tokens, and digests of the ids and of the text that they decode to."""
    return round_trip(documents(spark, sf_dir), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {"op8_bpe": op8_bpe}
ORACLES = {}
