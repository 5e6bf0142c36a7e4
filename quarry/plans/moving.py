"""Queries of sources and sinks, which write a table and read it back, and of streams, which are run over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry import sources, streaming
from quarry.operators._store import shared_folder
from quarry.plans.registry import query

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _trip(df, suffix: str, schema: str | None = None, **options):
    """df, written to a new place and read from it."""
    path = f"{shared_folder(df.sparkSession)}/quarry/trip-{uuid.uuid4().hex}.{suffix}"
    sources.write_table(df, path, **options)
    return sources.open_table(df.sparkSession, path, schema=schema)


def _nation(t):
    return t("nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


_SCHEMA = "n_nationkey long, n_name string, n_regionkey long"
for _suffix in ("csv", "tsv", "json"):
    query(f"source_{_suffix}", _NATION)(lambda t, s=_suffix: _trip(_nation(t), s, _SCHEMA))
for _suffix in ("orc", "parquet"):
    query(f"source_{_suffix}", _NATION)(lambda t, s=_suffix: _trip(_nation(t), s))
query("source_partitioned", "SELECT n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation WHERE n_regionkey IN (1, 3)")(lambda t: _trip(_nation(t).select("n_name", "n_regionkey"), "parquet", partition_by=("n_regionkey",)).where("n_regionkey IN (1, 3)"))
query("source_text", "SELECT n_name AS value FROM nation")(lambda t: _trip(t("nation").select(F.col("n_name").alias("value")), "txt"))

query("sliding_windows", "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1")(
    lambda t: streaming.windowed(t("events"), "ts", "2 hours", [], [F.count("*").alias("n")], slide="1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")
)


@query("stream_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    events = t("events").select("ts", "event_type")
    path = f"{shared_folder(events.sparkSession)}/quarry/events-{uuid.uuid4().hex}"
    events.write.parquet(path)
    stream = streaming.event_stream(events.sparkSession, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields))
    counts = streaming.windowed(stream, "ts", "1 day", ["event_type"], [F.count("*").alias("n")])
    return streaming.run_to_memory(counts, f"windows_{uuid.uuid4().hex}").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_late_rows", "SELECT date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1")
def _(t):
    """With a watermark wider than the data's disorder nothing is late, whatever the files' order."""
    events = t("events").select("ts")
    path = f"{shared_folder(events.sparkSession)}/quarry/events-{uuid.uuid4().hex}"
    events.repartition(3, F.hash("ts")).write.parquet(path)
    stream = streaming.event_stream(events.sparkSession, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields))
    counts = streaming.windowed(stream, "ts", "1 day", [], [F.count("*").alias("n")], late="400 days")
    return streaming.run_to_memory(counts, f"late_{uuid.uuid4().hex}").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")
