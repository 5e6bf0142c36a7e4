"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quarry.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canonical(frame):
    def cell(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool) or type(v).__name__.startswith("bool"):
            return str(bool(v))
        return round(float(v), 4) if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and type(v).__name__.startswith(("int", "float", "uint")) else str(v)

    names = sorted(frame.columns)
    return names, sorted((tuple(cell(v) for v in row) for row in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False)), key=str)


SLOW = {name for name in catalog.queries() if name.startswith("model_")}


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql())))
def test_query_equals_its_sql(spark, db, name):
    names, rows = canonical(catalog.queries()[name](spark, SF).toPandas())
    expected_names, expected = canonical(db.sql(catalog.oracle_sql()[name]).df())
    assert names == expected_names
    assert len(rows) == len(expected)
    for a, b in zip(rows, expected, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-3 * max(1, abs(x)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
