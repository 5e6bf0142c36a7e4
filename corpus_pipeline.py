"""From raw documents to packed training sequences, in five stages over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import near_dedup, packing, pii, quality_classifier, quality_rules
from quarry.llm._common import documents, written


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the tables' labels, scores 0.7 or more."""
    return quality_classifier.accepted(docs, "text", quality_classifier.fitted(spark, sf_dir))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep; the rules are weighed on what this stage was given."""
    return quality_rules.accepted(docs, "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return near_dedup.one_of_each(docs, "doc_id", "text", n=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [EMAIL], [IP], [CARD] and [PHONE] in place of personal data, and n_chars to fit."""
    return pii.redacted(docs, "text").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces with their texts, and their bins: the rows of a bin, joined, are a training sequence."""
    return packing.packed_texts(docs, "doc_id", "text", "source").withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: No SQL: classifier, expectation-maximisation, tagger and best fit are not expressible; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each result written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
