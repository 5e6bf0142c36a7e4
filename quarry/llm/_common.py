"""What the operators share: places for intermediate tables, text rules and hashing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of about so many bytes are worked on at once.
PART_BYTES = 8 << 20
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


_MADE: list[list[str]] = []


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it is computed once, and no executor's loss can take it."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes at its end the tables written inside it, but for what is written by the function that it gives."""
    kept: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        found = written(df, name)
        kept.append(_MADE[-1].pop())
        return found

    _MADE.append([])
    try:
        yield keep
    finally:
        made = _MADE.pop()
        for path in made:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        if _MADE:
            _MADE[-1] += kept


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def parts(batch: pa.RecordBatch, rows: int, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slabs of `rows` rows and about `size` bytes of texts at most; a longer text is a slab of its own."""
    weight = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(weight), 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        n = min(rows, max(1, int(np.searchsorted(total, before + size, side="right")) - at))
        yield batch.slice(at, n)
        at += n


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[list[dict]], list[tuple]]], slab: int = 512) -> DataFrame:
    """mapInArrow over slabs of rows: make() gives, once a task, a function from a list of columns to a list of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in parts(batch, slab):
                out = f(*part.columns)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t) for c, t in zip(out, arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, needs: list[str], schema: str, make: Callable, slab: int = 512) -> DataFrame:
    """df with columns added that are computed from the columns `needs`, rows and order kept; whole rows pass, so none is joined back."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    more = _parse_datatype_string(schema)
    arrow, places = to_arrow_schema(more), [df.columns.index(c) for c in needs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in parts(batch, slab):
                out = f(*(part.column(i) for i in places))
                new = [pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t) for c, t in zip(out, arrow.types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *arrow.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *more.fields]))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes for df to have no such column (in any case)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts' UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text whose A-Z are lower-cased."""
    return text.lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound; they depend on the word alone."""

    def __init__(self, bound: int = 400_000) -> None:
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` words."""
    n = max(0, len(hashes) - width + 1)
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n + i])
    return total


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of n-word shingles; of a shorter sequence, one hash of the whole; of none, none."""
    return np.unique(window_hashes(hashes, min(n, len(hashes)))) if len(hashes) else hashes
