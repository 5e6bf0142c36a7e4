"""Operators on awkward rows, and against known values."""

import inspect
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry import sources, streaming
from quarry.functions import special
from quarry.operators import binning, cleaning, encoding, features, graph, models, quantiles, relational, scaling, statistics, text, timeseries


def test_special_functions_have_known_values():
    assert special.norm_ppf(0.975) == pytest.approx(1.959963984540054)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05)
    assert special.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05)
    assert special.gamma_q(3, 0.5) == pytest.approx(0.9856123220330293)


def test_normal_distribution_function(spark):
    rows = spark.createDataFrame([(x / 4,) for x in range(-16, 17)], "x double").select("x", special.norm_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r["p"] - (1 - special.norm_sf(r["x"]))) < 1e-7 for r in rows)


def test_slicing_errors(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        relational.select_columns(df, ["nope"])
    with pytest.raises(IndexError):
        relational.select_columns(df, [4])
    with pytest.raises(ValueError):
        relational.stack_rows([df, df.withColumnRenamed("id", "x")])


def test_dense_numbers_need_no_single_task(spark):
    df = relational.dense_number(spark.range(1000).repartition(7), ["id"])
    assert all(r["id"] == r["row_no"] for r in df.collect())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, g string, x double")
    assert relational.drop_duplicates(empty, ["g"], ["id"]).count() == 0
    assert relational.shuffled(empty, "id").count() == 0
    assert timeseries.rolling(empty, "x", ["g"], ["id"], 3).count() == 0
    assert text.gram_counts(empty, text.word_ngrams(text.split_words(F.col("g")), 2)).count() == 0
    assert encoding.label_table(empty, "g").count() == 0


def test_nulls_are_kept_apart(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, "nan", 1.0), (3, "a", None)], "id long, g string, x double")
    clean = cleaning.null_if_nan(df)
    assert [(r["g"], r["x"]) for r in clean.orderBy("id").collect()] == [(None, None), (None, 1.0), ("a", None)]
    assert cleaning.fit_modes(clean, ["g"]) == {"g": "a"}
    assert cleaning.drop_null_rows(clean).count() == 0
    labels = {r["id"]: r["label"] for r in encoding.encode_labels(clean, "g", encoding.label_table(clean, "g")).collect()}
    assert labels == {1: -1, 2: -1, 3: 0}


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    for fit in (scaling.fit_standard, scaling.fit_min_max, scaling.fit_robust):
        assert {r["x"] for r in fit(df, ["x"]).transform(df).collect()} == {0.0}


def test_inverse_scaling(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (7.5,)], "x double")
    m = scaling.fit_min_max(df, ["x"], -3, 4)
    assert sorted(r["x"] for r in m.inverse(m.transform(df)).collect()) == pytest.approx([1.0, 2.0, 7.5])


def test_helmert_columns_sum_to_zero_but_for_none():
    m = encoding.helmert_matrix(4)
    assert len(m) == 4 and len(m[0]) == 3
    assert all(abs(sum(row[j] for row in m)) < 1e-12 for j in range(3))


def test_geohash_of_known_places(spark):
    df = spark.createDataFrame([(57.64911, 10.40744, "u4pruyd"), (0.0, 0.0, "s000000"), (95.0, 0.0, None)], "lat double, lon double, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", features.geohash(F.col("lat"), F.col("lon"), 7)).collect())


def test_chi_merge_finds_a_planted_cut(spark):
    df = spark.range(2000).select((F.col("id") / 100).alias("x"), (F.col("id") >= 1200).cast("int").alias("y"))
    edges = binning.chi_merge_edges(df, "x", "y", 2, 3.84)
    assert len(edges) == 3 and abs(edges[1] - 12) < 0.5


def test_shortest_paths_on_a_small_graph(spark):
    e = spark.createDataFrame([(0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0), (1, 3, 5.0), (9, 0, 1.0)], "src long, dst long, w double")
    assert {r["node"]: r["distance"] for r in graph.shortest_paths(e, 0).collect()} == {0: 0.0, 2: 1.0, 1: 3.0, 3: 8.0}
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(e).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0)


def test_chi_merge_starts_from_distinct_values(spark):
    """A hot value that takes most quantiles hides no cut in the tail."""
    df = spark.range(20000).select(F.greatest(F.col("id") - 19800, F.lit(0)).cast("double").alias("x")).withColumn("y", F.col("x").between(101, 131).cast("int"))
    assert binning.chi_merge_edges(df, "x", "y", 3, 3.84) == [0.0, 101.0, 132.0, 199.0]


def test_paths_end_only_where_asked(spark):
    e = spark.range(12).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert inspect.signature(graph.shortest_paths).parameters["limit"].default is None
    assert graph.bfs(e, 0).count() == 13 and graph.bfs(e, 0, limit=3).count() == 4


def test_linear_model_recovers_weights(spark):
    df = spark.range(200).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn("y", 3 + 2 * F.col("a") - F.col("b"))
    m = models.fit_linear(df, ["a", "b"], "y")
    assert m.weights == pytest.approx((2, -1)) and m.intercept == pytest.approx(3)


def test_average_ranks_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (None,)], "x double")
    assert sorted((r["x"], r["rank"]) for r in statistics.average_ranks(df, "x").collect()) == [(1.0, 1.0), (3.0, 2.5), (3.0, 2.5)]


def test_similar_categories_merge_into_the_commonest(spark):
    df = spark.createDataFrame([("berlin",)] * 3 + [("berlim",), ("paris",)], "c string")
    assert cleaning.merge_similar(df, "c", 0.8) == {"berlin": "berlin", "berlim": "berlin", "paris": "paris"}


def test_categories_that_differ_in_the_first_letter_merge(spark):
    df = spark.createDataFrame([("berlin",)] * 3 + [("Berlin",), (" berlin",), ("",), ("paris",)], "c string")
    assert cleaning.merge_similar(df, "c", 0.8) == {"berlin": "berlin", "Berlin": "berlin", " berlin": "berlin", "": "", "paris": "paris"}


@pytest.mark.parametrize("suffix", ["parquet", "csv", "json", "orc"])
def test_files_go_round(spark, tmp_path, suffix):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    path = str(tmp_path / f"t.{suffix}")
    sources.write_table(df, path)
    assert sorted(map(tuple, sources.open_table(spark, path, schema="id long, s string").collect())) == [(1, "a"), (2, None)]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    what = [F.count("*").alias("n"), F.sum("value").alias("total")]
    stream = streaming.windowed(streaming.event_stream(spark, str(tmp_path / "in"), schema), "ts", "1 day", ["event_type"], what, late="30 days")
    got = streaming.run_to_memory(stream, "days").collect()
    want = streaming.windowed(events, "ts", "1 day", ["event_type"], what).collect()
    key = lambda r: (r["start"], r["event_type"], r["n"])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert math.isclose(sum(r["total"] for r in got), sum(r["total"] for r in want))


def test_row_numbers_are_whole_with_payload_columns(spark, tmp_path):
    """Written and read, under adaptive execution with its defaults, over enough rows for many partitions."""
    rows = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        relational.dense_number(rows, ["l_orderkey", "l_linenumber"]).write.parquet(str(tmp_path / "n"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = spark.read.parquet(str(tmp_path / "n"))
    n = rows.count()
    assert got.select("row_no").distinct().count() == n == got.agg(F.max("row_no") + 1).first()[0]
    w = Window.orderBy("l_orderkey", "l_linenumber")
    assert got.select("row_no", (F.row_number().over(w) - 1).alias("k")).where("row_no <> k").count() == 0
    assert got.drop("row_no").exceptAll(rows).count() == 0


def test_running_sums_equal_one_window(spark):
    rows = spark.range(5000).select((F.col("id") * 7 % 5003).cast("double").alias("x"), (F.col("id") % 11).alias("c"))
    got = relational.running_sums(rows, "x", {"before": "c"}, parts=9)
    plain = F.coalesce(F.sum("c").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    assert got.withColumn("plain", plain).where("before <> plain").count() == 0 and got.count() == 5000
    assert relational.running_sums(rows.where("x < 0"), "x", {"before": "c"}).count() == 0


def test_random_numbers_mix_ids_and_seeds(spark):
    ids = spark.range(20000).select((F.col("id") + (1 << 61)).alias("id"))
    folds = relational.repeated_folds(ids, "id", 5, 3).groupBy("id").pivot("repeat", [0, 1, 2]).agg(F.first("fold"))
    for a, b in ((0, 1), (0, 2), (1, 2)):
        same = folds.where(F.col(str(a)) == F.col(str(b))).count() / 20000
        assert abs(same - 0.2) < 0.02
    sizes = [r[1] for r in folds.groupBy("0").count().collect()]
    assert max(sizes) / min(sizes) < 1.15
    u = ids.select(relational.pseudo_random("id", 1).alias("a"), relational.pseudo_random("id", 2).alias("b"))
    assert abs(u.agg(F.corr("a", "b")).first()[0]) < 0.03


def test_least_squares_counts_rows_without_nulls(spark):
    rows = spark.createDataFrame([(float(i), float(i * i % 7), None if i % 4 == 0 else 3.0 * i + 1) for i in range(40)], "a double, b double, y double")
    whole = models.fit_linear(rows, ["a", "b"], "y", ridge=2.0)
    clean = models.fit_linear(rows.dropna(), ["a", "b"], "y", ridge=2.0)
    assert whole == clean


def test_exact_quantiles_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for x in (rng.standard_normal(30_011), np.repeat([1.0, 2.0, 5.0], [9000, 1, 700]), rng.exponential(size=7) ** 9, np.array([4.0]), np.concatenate([np.zeros(20_000), rng.random(9)]), np.arange(10_000.0)):
        df = spark.createDataFrame([(float(v), float(-v)) for v in x] + [(None, None)], "a double, b double").repartition(3)
        at = [0.0, 0.003, 0.25, 0.5, 0.75, 0.9997, 1.0]
        got = quantiles.exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, at)
        assert got["a"] == pytest.approx(np.quantile(x, at).tolist(), rel=1e-9) and got["b"] == pytest.approx(np.quantile(-x, at).tolist(), rel=1e-9)
    assert quantiles.exact_quantiles(df.where("a < -1"), ["a"], [0.5]) == {"a": [None]}
