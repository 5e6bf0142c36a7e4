"""The registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans import analysis, deeper, fitted, kernels, learned, moving, more_sql, relational, samples, series  # noqa: F401  they register their queries
from quarry.plans.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by return flag and line status."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    )


FLAGSHIP_SQL = """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem GROUP BY 1, 2"""


def queries() -> dict:
    return {"flagship": flagship, **QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"flagship": FLAGSHIP_SQL, **ORACLES}
