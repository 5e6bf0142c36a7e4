"""What the findings of the second round asked for: operators on pairs do not expand copies."""

from quarry.operators import records


def test_copies_are_linked_once_and_no_link_between_different_records_is_lost(spark, monkeypatch):
    words = ["abcdefgh", "abcdefgx", "abcdefyx", "qrstuvwz", None]
    rows = [(i, words[i % 5] if i < 900 else f"only{i}only", "1", "2") for i in range(920)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string").repartition(3)
    links, components = [], records.components
    monkeypatch.setattr(records, "components", lambda pairs: links.append(pairs.count()) or components(pairs))
    groups = {r["id"]: r["group"] for r in records.fuzzy_groups(df.where("id < 900"), "id", ["a"], 0.8).collect()}
    assert groups == {i: {1: 0, 2: 0}.get(i % 5, i % 5) for i in range(900)}
    kept = {r["id"] for r in records.drop_similar(df, "id", ["a", "b", "c"], 0.9).collect()}
    assert kept == {0, 1, 2, 3, 4, *range(900, 920)}
    assert {r["id"] for r in records.drop_similar(df, "id", ["a", "b", "c"], 0.5).collect()} == {0}
    assert max(links) < 2 * len(rows)
