"""Sources and sinks by suffix: each is one of Spark's readers or writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READERS = {"parquet": "parquet", "orc": "orc", "json": "json", "jsonl": "json", "csv": "csv", "tsv": "csv", "txt": "text", "text": "text"}


def kind_of(path: str) -> str:
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    return READERS.get(suffix, "binaryFile")


def open_table(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """A file or folder as a table. Give a schema for JSON and CSV: to infer one reads the data twice."""
    kind = kind or kind_of(path)
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",")
    if schema:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def write_table(df: DataFrame, path: str, kind: str | None = None, mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
    kind = kind or kind_of(path)
    writer = df.write.format(kind).mode(mode).options(**options)
    if kind == "csv":
        writer = writer.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
