"""Streams of events: windowed aggregates with watermarks, and sessions. The same functions take batches, which tests compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(df: DataFrame, ts: str, width: str, by: Sequence[str], aggregates: Sequence[Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling or sliding windows; `late` is the watermark of a stream."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        df = df.withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.groupBy(w.alias("w"), *by).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *(c for c in [F.col(n) for n in _names(aggregates)]))


def sessions(df: DataFrame, ts: str, gap: str, by: Sequence[str], aggregates: Sequence[Column], late: str | None = None) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        df = df.withWatermark(ts, late)
    return df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *(F.col(n) for n in _names(aggregates)))


def _names(aggregates: Sequence[Column]) -> list[str]:
    return [c._jc.toString().rpartition(" AS ")[2].strip("`") for c in aggregates]


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drives a stream over what is there now, and gives the result."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
