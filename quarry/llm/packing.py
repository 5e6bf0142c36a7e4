"""Conflict-constrained best-fit packing of documents into training sequences.

A bin has a capacity in words and holds no two documents of one source, and no two of one cluster of duplicates. Documents longer
than a bin fill bins of their own; what is left of them is packed with the rest. Open bins are ordered by what is left in
them; each carries a bitmap of the sources and clusters that it holds. For each piece, largest first, the search starts at the smallest
room that holds it and goes on to the next larger ones until a bin without a conflict is found: the tightest compatible bin. Of each
room it is known how many of its bins hold a source or a cluster, so that rooms where all do are passed over at once.

Rows are dealt to shards of about SHARD pieces by a hash of the row (equal rows are told apart by their number), so that no source or cluster,
however large, lands in one task, and bins do not depend on partitions; each shard packs on its own. Then the bins of all shards
that are at most half full are packed once more, as pieces with all their sources and clusters, until one task holds them or they get no
fewer: what a bin leaves open does not depend on its shard alone.

Defined cases: a null or empty text has no words and takes no bin (one row without a bin); a very long text fills as many bins as it
needs; null sources are one source; of bins with equal room a compatible one is taken in a fixed order; repeated rows are packed
each (one cluster, so in different bins); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import as_bytes, documents, map_rows, tidied, written

CAPACITY = 1024
SHARD = 20_000
#: Copies of one row are numbered so many at a time.
RUN = 4096

PIECES = "shard int, bin long, id long, digest long, copy long, start long, n_words long, fill long, source long, cluster long"


def pack(sizes: list[int], marks: list[list], capacity: int = CAPACITY) -> list[int]:
    """Bin of each piece (sizes 1 to capacity); best fit in the order given. No two pieces of a bin have a mark in common."""
    times = Counter(m for own in marks for m in own)
    bit = {m: i for i, m in enumerate(m for m, n in times.items() if n > 1)}  # a mark of one piece conflicts with nothing
    rooms: list[dict[int, dict[int, None]]] = [{} for _ in range(capacity + 1)]  # of each room: bitmap -> bins, oldest first
    total = [0] * (capacity + 1)  # bins of each room
    holding: list[dict[int, int]] = [{} for _ in bit]  # of each mark: room -> bins that have it
    of_bin: list[list[int]] = []
    held = 0  # bit r: some bin has room r

    def put(b: int, room: int, bitmap: int, sign: int) -> None:
        nonlocal held
        if sign > 0:
            rooms[room].setdefault(bitmap, {})[b] = None
        else:
            same = rooms[room][bitmap]
            del same[b]
            if not same:
                del rooms[room][bitmap]
        total[room] += sign
        if total[room] == (sign > 0):  # it became one, or none
            held ^= 1 << room
        for h in of_bin[b]:
            holding[h][room] = holding[h].get(room, 0) + sign

    found = []
    for size, own in zip(sizes, marks, strict=True):
        bits = [bit[m] for m in own if m in bit]
        mask = sum(1 << h for h in bits)
        left, room, best = held >> size, size, None
        while left and best is None:
            step = (left & -left).bit_length()
            room, left = room + step - 1, left >> step
            if all(holding[h].get(room, 0) < total[room] for h in bits):
                best = next(((next(iter(bins)), bitmap) for bitmap, bins in rooms[room].items() if not bitmap & mask), None)
            room += best is None
        if best is None:
            b, bitmap, rest = len(of_bin), 0, capacity
            of_bin.append([])
        else:
            (b, bitmap), rest = best, room
            put(b, rest, bitmap, -1)
        of_bin[b] += bits
        if rest > size:
            put(b, rest - size, bitmap | mask, 1)
        found.append(b)
    return found


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, cluster_col: str | None = None) -> DataFrame:
    """(id, digest, source, cluster, n_words): whole texts' words. Without a column of clusters, texts of equal lower-cased words are one."""

    def make():
        number = lambda x: xxhash.xxh3_64_intdigest(x) - (1 << 63)

        def of(ids: pa.Array, texts: pa.Array, sources: pa.Array, *clusters: pa.Array) -> list:
            raw = as_bytes(texts)
            found = [t.lower().split() for t in raw]
            digests = [number(t) for t in raw]
            own = [number(" ".join(map(str, c))) if (c := x[0]) is not None else number(b" ".join(w)) for x, w in zip(([v] for v in clusters[0].to_pylist()), found, strict=True)] if clusters else [number(b" ".join(w)) for w in found]
            return [ids, digests, [number(s) if s is not None else None for s in sources.to_pylist()], own, [len(w) for w in found]]

        return of

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"), *([F.col(cluster_col).cast("string").alias("cluster")] if cluster_col else []))
    return map_rows(rows, "id long, digest long, source long, cluster long, n_words long", make)


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `copy`: equal rows are counted, before they move, and told apart by a number."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    return runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1))).drop("n", "run")


def merged(open_: DataFrame, capacity: int) -> DataFrame | None:
    """open_ (shard, bin, fill, marks array<long>) -> (shard, bin, to_shard, to_bin, to_fill): bins that are put together, under the name of one of them."""

    def fill(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("fill", "shard", "bin", "marks", "members")), strict=True), key=lambda r: (-r[0], r[1], r[2]))
        bins: dict[int, list] = {}
        for b, r in zip(pack([r[0] for r in rows], [r[3] for r in rows], capacity), rows, strict=True):
            bins.setdefault(b, []).append(r)
        out = [(own[0][1], own[0][2], sum(r[0] for r in own), [m for r in own for m in r[3]], [m for r in own for m in r[4]]) for own in bins.values()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "bin", "fill", "marks", "members"])

    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("shard", pa.int32()), ("bin", pa.int64())])))
    schema = "shard int, bin long, fill long, marks array<long>, members array<struct<shard:int,bin:long>>"
    bins = open_.withColumn("members", F.array(F.struct("shard", "bin")))
    done, n, before = None, open_.count(), None
    while n > 1 and (before is None or n < 0.9 * before):
        groups = -(-n // SHARD)
        bins = written(bins.groupBy(F.pmod(F.xxhash64("shard", "bin", F.lit(n)), F.lit(groups)).alias("group")).applyInArrow(fill, schema), "merged")
        full = bins.where(2 * F.col("fill") > capacity)
        done = full if done is None else done.unionByName(full)
        bins = bins.where(2 * F.col("fill") <= capacity)
        before, n = n, bins.count() if groups > 1 else 0
    if done is None:
        return None
    each = done.unionByName(bins).withColumn("m", F.explode("members"))
    return each.select(F.col("m.shard").alias("shard"), F.col("m.bin").alias("bin"), F.col("shard").alias("to_shard"), F.col("bin").alias("to_bin"), F.col("fill").alias("to_fill"))


def pieces(docs: DataFrame, id_col: str, text_col: str, source_col: str, capacity: int = CAPACITY, cluster_col: str | None = None) -> DataFrame:
    """(shard, bin, id, digest, copy, start, n_words, fill): each piece of each row, where it starts in the row's words, and its bin's words in all."""
    sizes = written(measured(docs, id_col, text_col, source_col, cluster_col), "sizes")
    shards = max(1, -(-sizes.count() // SHARD))

    def fill(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("id", "digest", "copy", "n_words", "source", "cluster")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        shard = table["shard"][0].as_py()
        whole = [(r, start, capacity) for r in rows for start in range(0, r[3] - capacity + 1, capacity)]
        rest = sorted(((r, r[3] - r[3] % capacity, r[3] % capacity) for r in rows if r[3] % capacity), key=lambda x: -x[2])
        bins = [*range(len(whole)), *(len(whole) + b for b in pack([n for *_, n in rest], [[("s", r[4]), ("c", r[5])] for r, *_ in rest], capacity))]
        total: Counter = Counter()
        for b, (_, _, n) in zip(bins, whole + rest, strict=True):
            total[b] += n
        out = [(shard, b, *r[:3], start, n, total[b], r[4], r[5]) for b, (r, start, n) in zip(bins, whole + rest, strict=True)]
        out += [(shard, None, *r[:3], 0, 0, None, r[4], r[5]) for r in rows if r[3] == 0]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.int64()] * 9), strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    dealt = numbered(sizes).withColumn("shard", F.pmod(F.xxhash64("id", "digest", "source", "copy"), F.lit(shards)).cast("int"))
    found = written(dealt.groupBy("shard").applyInArrow(fill, PIECES), "pieces")
    if shards > 1:
        # A mark is a source or a cluster; the hash tells the two apart.
        marks = F.array_union(F.collect_set(F.xxhash64(F.lit("s"), "source")), F.collect_set(F.xxhash64(F.lit("c"), "cluster")))
        open_ = found.where(2 * F.col("fill") <= capacity).groupBy("shard", "bin").agg(F.first("fill").alias("fill"), marks.alias("marks"))
        moved = merged(written(open_, "open"), capacity)
        if moved is not None:
            found = found.join(moved, ["shard", "bin"], "left").withColumns({"shard": F.coalesce("to_shard", "shard"), "bin": F.coalesce("to_bin", "bin"), "fill": F.coalesce("to_fill", "fill")})
    return found.select("shard", "bin", "id", "digest", "copy", "start", "n_words", "fill")


def packed(docs: DataFrame, id_col: str, text_col: str, source_col: str, capacity: int = CAPACITY, cluster_col: str | None = None) -> DataFrame:
    """(shard, bin, id, start, n_words, fill): the pieces and their bins. cluster_col: what tells duplicates, such as near_dedup's component."""
    with tidied(docs.sparkSession) as keep:
        found = pieces(docs, id_col, text_col, source_col, capacity, cluster_col)
        return keep(found.select("shard", F.col("bin").cast("int").alias("bin"), "id", "start", "n_words", "fill"), "packed")


def cut(text: str, starts: list[int]) -> list[str]:
    """A text's parts, each from its first word to the next part's first word; joined they are the text."""
    if len(starts) == 1:
        return [text]
    places, want = [0], set(starts) - {0}
    for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if i in want:
            places.append(m.start())
    return [text[a:b] for a, b in zip(places, [*places[1:], len(text)], strict=True)]


def packed_texts(docs: DataFrame, id_col: str, text_col: str, source_col: str, capacity: int = CAPACITY, cluster_col: str | None = None) -> DataFrame:
    """(shard, bin, id, start, n_words, fill, text): as packed, with each piece's text; a document's pieces, joined, are its whole text."""
    arrow = pa.schema([("shard", pa.int32()), ("bin", pa.int32()), ("id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("fill", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            for uid, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.sort(key=lambda x: x["start"])
                rows = [(x["shard"], x["bin"], uid, x["start"], x["n_words"], x["fill"], t) for x, t in zip(own, cut(text or "", [x["start"] for x in own]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def digested():
        return lambda ids, texts: [ids, texts, [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in as_bytes(texts)]]

    with tidied(docs.sparkSession) as keep:
        found = pieces(docs, id_col, text_col, source_col, capacity, cluster_col)
        by_row = found.groupBy("id", "digest", "copy").agg(F.collect_list(F.struct("shard", F.col("bin").cast("int").alias("bin"), "start", "n_words", "fill")).alias("own"))
        texts = map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id long, text string, digest long", digested)
        once = texts.groupBy("id", "digest").agg(F.min("text").alias("text")).withColumnsRenamed({"id": "t_id", "digest": "t_digest"})
        both = by_row.join(once, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("digest") == F.col("t_digest")))
        return keep(both.select("id", "text", "own").mapInArrow(run, "shard int, bin int, id long, start long, n_words long, fill long, text string"), "packed")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its bin (shard and number), where it starts, its words, and its bin's words in all."""
    return packed(documents(spark, sf_dir), "doc_id", "text", "source").withColumnRenamed("id", "doc_id")


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES = {}
