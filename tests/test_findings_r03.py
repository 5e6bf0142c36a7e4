"""What the findings of the third round asked for: neighbours of large tables without all pairs, and sums that pass the range of a long."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import _store, boxes, clusters, graph, neighbours, records, relational, resampling, statistics


@pytest.fixture(scope="module")
def copies(spark):
    """1,800 rows at 60 points on a lattice, so that distances tie; a seventh is `few`."""
    at = (F.col("id") * 7) % 60
    return spark.range(1800).select("id", (at % 10).cast("double").alias("x"), F.floor(at / 10).cast("double").alias("y"), (F.col("id") % 3).alias("g"), (F.col("id") % 7 == 0).alias("few")).repartition(3)


@pytest.fixture
def meetings(monkeypatch):
    """(rows, points) of every meeting."""
    seen = []

    def counted(rows, points, *args, **kw):
        seen.append((rows.count(), points.count()))
        return boxes.best_rows(rows, points, *args, **kw)

    monkeypatch.setattr(neighbours, "best_rows", counted)
    return seen


def ranked(rows, queries, k):
    """{query: its k nearest (distance, id, row)}, by all pairs."""
    xy, ids = np.array([(r["x"], r["y"]) for r in rows]), np.array([r["id"] for r in rows])
    found = {}
    for q in queries:
        d = np.sqrt((xy[:, 0] - q["x"]) ** 2 + (xy[:, 1] - q["y"]) ** 2)
        found[q["id"]] = [(d[i], ids[i], rows[i]) for i in np.lexsort((ids, d)) if ids[i] != q["id"]][:k]
    return found


def test_few_distances_of_spread_points_are_computed(monkeypatch):
    rng, seen, distances = np.random.default_rng(0), [], boxes.distances
    monkeypatch.setattr(boxes, "distances", lambda a, b, metric: seen.append(len(a) * len(b)) or distances(a, b, metric))
    x = rng.random((20_000, 2))
    for farthest in (False, True):
        seen.clear()
        place, key, ids = boxes.best(x, x, np.arange(len(x)), 4, "euclidean", farthest)
        assert len(place) == 4 * len(x) and sum(seen) < len(x) ** 2 / 20
        for q in (0, 7, 19_999):
            d = distances(x[q : q + 1], x, "euclidean")[0]
            assert ids[place == q].tolist() == np.argsort(-d if farthest else d)[:4].tolist()


def test_many_boxes_and_divided_meetings_give_what_all_pairs_give(spark, monkeypatch):
    rng = np.random.default_rng(2)
    xy = np.round(rng.normal(size=(900, 2)), 1)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double").repartition(3)
    rows = df.orderBy("id").collect()
    for name, value in (("BOX", 50), ("PART", 60), ("DRAWN", 200)):
        monkeypatch.setattr(boxes, name, value)
    for metric in ("euclidean", "manhattan"):
        for farthest in (False, True):
            got = neighbours.nearest(df.where("id % 4 < 3"), df.where("id % 2 = 0"), "id", ["x", "y"], 3, metric, farthest).orderBy("query", "rank").collect()
            expected = []
            for q in (r for r in rows if r["id"] % 2 == 0):
                gaps = {r["id"]: (abs(r["x"] - q["x"]), abs(r["y"] - q["y"])) for r in rows if r["id"] % 4 < 3 and r["id"] != q["id"]}
                d = {i: np.sqrt(a * a + b * b) if metric == "euclidean" else a + b for i, (a, b) in gaps.items()}
                expected += [(q["id"], i, d[i], n + 1) for n, i in enumerate(sorted(d, key=lambda i: (-d[i] if farthest else d[i], i))[:3])]
            assert [tuple(r) for r in got] == expected


def test_edited_neighbours_meets_copies_once(copies, meetings):
    got = {r["id"] for r in neighbours.edited(copies, "id", ["x", "y"], "g", 3).collect()}
    rows = copies.collect()
    near = ranked(rows, rows, 3)
    votes = {q: [r["g"] for _, _, r in found] for q, found in near.items()}
    assert got == {r["id"] for r in rows if r["g"] == min(votes[r["id"]], key=lambda g: (-votes[r["id"]].count(g), g))}
    assert meetings == [(60 * 4, 60)]


def test_local_outlier_factor_meets_copies_once(copies, meetings):
    got = {r["id"]: r["lof"] for r in neighbours.local_outlier_factor(copies.where("id < 600"), "id", ["x", "y"], 7).collect()}
    rows = copies.where("id < 600").orderBy("id").collect()
    near = ranked(rows, rows, 7)
    far = {q: found[-1][0] for q, found in near.items()}
    density = {q: 1 / (np.mean([max(d, far[i]) for d, i, _ in found]) + 1e-12) for q, found in near.items()}
    assert got == pytest.approx({q: np.mean([density[i] for _, i, _ in found]) / density[q] for q, found in near.items()})
    assert meetings == [(60 * 8, 60)]


def test_nearest_neighbours_meets_copies_once(copies, meetings):
    got = neighbours.nearest(copies, copies, "id", ["x", "y"], 3).orderBy("query", "rank").collect()
    rows = copies.orderBy("id").collect()
    assert [tuple(r) for r in got] == [(q, i, d, n + 1) for q, found in ranked(rows, rows, 3).items() for n, (d, i, _) in enumerate(found)]
    assert meetings == [(60 * 4, 60)]


def test_relief_meets_copies_once(copies, meetings):
    got = {r["name"]: r["weight"] for r in resampling.relief(copies, "id", ["x", "y"], "few", 3).collect()}
    rows = copies.orderBy("id").collect()
    scaled = [{"id": r["id"], "x": r["x"] / 9, "y": r["y"] / 5, "few": r["few"]} for r in rows]
    gaps = {True: [], False: []}
    for value in (True, False):
        own, other = ([r for r in scaled if (r["few"] == value) == same] for same in (True, False))
        for same, pool in ((True, own), (False, other)):
            for q, found in ranked(pool, own, 3).items():
                gaps[same] += [[abs(r[c] - scaled[q][c]) for c in "xy"] for _, _, r in found]
    assert got == pytest.approx(dict(zip("xy", np.mean(gaps[False], axis=0) - np.mean(gaps[True], axis=0), strict=True)))
    assert len(meetings) == 4 and all(rows <= 60 * 4 and points <= 60 for rows, points in meetings)


def test_tomek_links_meets_copies_once(copies, meetings):
    df = copies.where("id < 60 OR id % 60 < 30")
    got = {tuple(r) for r in neighbours.tomek_links(df, "id", ["x", "y"], "g").collect()}
    rows = df.orderBy("id").collect()
    near = {q: found[0][2] for q, found in ranked(rows, rows, 1).items()}
    assert got == {(r["id"], near[r["id"]]["id"]) for r in rows if r["id"] < near[r["id"]]["id"] and near[near[r["id"]]["id"]]["id"] == r["id"] and near[r["id"]]["g"] != r["g"]}
    assert meetings == [(30 * 2 + 30, 60)]


@pytest.fixture(scope="module")
def spread(spark):
    """400 points in loose groups, and 30 copies of one of them."""
    rng = np.random.default_rng(5)
    xy = np.round(np.concatenate([rng.normal(at, 0.7, (100, 2)) for at in ((0, 0), (4, 0), (2, 5), (-3, 4))]), 2)
    xy = np.concatenate([xy, np.repeat(xy[:1], 30, axis=0)])
    return spark.createDataFrame([(i + 10, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double").repartition(3)


def pairs_within(rows, width):
    """{id: [(squared distance, id)] within, itself too}, by all pairs."""
    xy, ids = np.array([(r["x"], r["y"]) for r in rows]), [r["id"] for r in rows]
    d = (xy[:, None, 0] - xy[:, 0]) ** 2 + (xy[:, None, 1] - xy[:, 1]) ** 2
    return {i: sorted((d[a, b], ids[b]) for b in np.flatnonzero(d[a] <= width * width)) for a, i in enumerate(ids)}


def test_density_clusters_keep_no_pairs(spread, meetings):
    for eps, least in ((0.25, 4), (0.6, 6)):
        near = pairs_within(spread.orderBy("id").collect(), eps)
        cores = {i for i, found in near.items() if len(found) >= least}
        label = {i: i for i in cores}
        while (new := {i: min(label[b] for _, b in near[i] if b in cores) for i in cores}) != label:
            label = new
        expected = {i: label.get(i, min((label[b] for _, b in found if b in cores), default=-1)) for i, found in near.items()}
        assert len(set(expected.values())) > 3
        assert {r["id"]: r["cluster"] for r in neighbours.density_clusters(spread, "id", "x", "y", eps, least).collect()} == expected
    assert len(meetings) == 2 and all(rows <= 430 and points <= 400 for rows, points in meetings)


def test_quick_shift_keeps_no_pairs(spread, monkeypatch):
    sizes = []
    for module, name in ((_store, "stored"), (graph, "checkpointed")):
        monkeypatch.setattr(module, name, lambda df, *args, f=getattr(module, name): sizes.append(f(df, *args)) or sizes[-1])
    for width in (0.3, 1.5):
        near = pairs_within(spread.orderBy("id").collect(), width)
        rank = {i: (len(found), -i) for i, found in near.items()}
        to = {i: next((b for _, b in found if rank[b] > rank[i]), i) for i, found in near.items()}
        while (new := {i: to[b] for i, b in to.items()}) != to:
            to = new
        assert {r["id"]: r["cluster"] for r in clusters.quick_shift(spread, "id", "x", "y", width).collect()} == to
    assert max(df.count() for df in sizes) <= 430


def test_adaptive_quotas_meet_copies_once(copies, meetings):
    got = {r["query"]: r["quota"] for r in resampling.adaptive_quotas(copies, "id", ["x", "y"], "few", True).collect()}
    rows = copies.orderBy("id").collect()
    few = [r for r in rows if r["few"]]
    share = {q: sum(not r["few"] for _, _, r in found) / 5 for q, found in ranked(rows, few, 5).items()}
    assert got == {q: round(s / sum(share.values()) * (len(rows) - 2 * len(few))) for q, s in share.items()}
    assert meetings == [(60 * 6, 60)]


def test_adasyn_meets_copies_once(copies, meetings):
    made = resampling.adasyn(copies, "id", ["x", "y"], "few", True).collect()
    quotas = {r["query"]: r["quota"] for r in resampling.adaptive_quotas(copies, "id", ["x", "y"], "few", True).collect() if r["quota"] > 0}
    assert {q: sum(r["source"] == q for r in made) for q in quotas} == quotas and len(made) == sum(quotas.values())
    assert meetings == [(60 * 6, 60)] * 2  # one for the made rows, one for the quotas asked here


def test_border_kinds_meet_copies_once(copies, meetings):
    got = {r["query"]: r["kind"] for r in resampling.border_kinds(copies, "id", ["x", "y"], "few", True).collect()}
    rows = copies.orderBy("id").collect()
    share = {q: sum(not r["few"] for _, _, r in found) / 10 for q, found in ranked(rows, [r for r in rows if r["few"]], 10).items()}
    assert got == {q: "noise" if s >= 1 else "danger" if s >= 0.5 else "safe" for q, s in share.items()}
    assert meetings == [(60 * 11, 60)]


def test_borderline_smote_meets_copies_once(copies, meetings):
    got = {r["source"]: (r["x"], r["y"]) for r in resampling.borderline_smote(copies, "id", ["x", "y"], "few", True).collect()}
    rows = copies.orderBy("id").collect()
    few = [r for r in rows if r["few"]]
    danger = {q for q, found in ranked(rows, few, 10).items() if 5 <= sum(not r["few"] for _, _, r in found) < 10}
    assert set(got) == danger and danger
    near = ranked(few, few, 5)
    for q, (x, y) in got.items():
        a = rows[q]
        assert any(abs((b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])) < 1e-9 and min(a["x"], b["x"]) <= x <= max(a["x"], b["x"]) for _, _, b in near[q])
    assert len(meetings) == 2 and all(rows <= 60 * k and points <= 60 for (rows, points), k in zip(meetings, (11, 6), strict=True))


def test_condensed_neighbours_meets_copies_once(copies, meetings):
    got = {r["id"] for r in resampling.condensed(copies, "id", ["x", "y"], "few", True, rounds=3).collect()}
    rows = copies.orderBy("id").collect()
    first = next(r["id"] for r in copies.where("NOT few").orderBy(relational.pseudo_random("id"), "id").limit(1).collect())
    kept = {r["id"] for r in rows if r["few"]} | {first}
    for _ in range(3):
        near = ranked([r for r in rows if r["id"] in kept], [r for r in rows if r["id"] not in kept], 1)
        kept |= {q for q, found in near.items() if found[0][2]["few"] != rows[q]["few"]}
    assert got == kept
    assert meetings and all(rows <= 60 * 2 and points <= 60 for rows, points in meetings)


def test_knn_classify_meets_copies_once(copies, meetings):
    train, asked = copies.where("id % 7 <> 3"), copies.where("id % 7 = 3")
    got = {r["query"]: r["predicted"] for r in neighbours.knn_classify(train, asked, "id", ["x", "y"], "few", 5).collect()}
    near = ranked(train.orderBy("id").collect(), asked.collect(), 5)
    assert got == {q: sum(r["few"] for _, _, r in found) > 2 for q, found in near.items()}
    assert meetings == [(60 * 6, 60)]


def near_missed(copies, version):
    rows = copies.orderBy("id").collect()
    few, many = [r for r in rows if r["few"]], [r for r in rows if not r["few"]]
    far = {}
    for q in many:
        d = sorted(np.sqrt((r["x"] - q["x"]) ** 2 + (r["y"] - q["y"]) ** 2) for r in few)
        far[q["id"]] = round(np.mean(d[-3:] if version == 2 else d[:3]), 9)
    if version == 3:
        asked = {i for found in ranked(many, few, 3).values() for _, i, _ in found}
        far = {q: -d for q, d in far.items() if q in asked}
    return {r["id"] for r in few} | set(sorted(far, key=lambda q: (far[q], q))[: len(few)])


def test_near_miss_meets_copies_once(copies, meetings):
    some = copies.where("NOT few OR x < 4")  # so that distances differ
    assert {r["id"] for r in resampling.near_miss(some, "id", ["x", "y"], "few", True).collect()} == near_missed(some, 1)
    assert len(meetings) == 1 and meetings[0][0] <= 60 * 4 and meetings[0][1] == 60


def test_near_miss_2_meets_copies_once(copies, meetings):
    assert {r["id"] for r in resampling.near_miss(copies, "id", ["x", "y"], "few", True, 2).collect()} == near_missed(copies, 2)
    assert meetings == [(60 * 4, 60)]


def test_near_miss_3_meets_copies_once(copies, meetings):
    some = copies.where("NOT few OR x < 4")
    assert {r["id"] for r in resampling.near_miss(some, "id", ["x", "y"], "few", True, 3).collect()} == near_missed(some, 3)
    assert len(meetings) == 2 and all(rows <= 60 * 4 and points <= 60 for rows, points in meetings)


def test_wilcoxon_signed_rank_of_two_million_rows(spark):
    n = 2_000_000
    df = spark.range(n).select((F.col("id") % 5).cast("double").alias("x"), F.when(F.col("id") % 5 < 4, F.col("id") % 5 + 1).otherwise(2).cast("double").alias("y"))
    r = statistics.wilcoxon_signed_rank(df, "x", "y").first()
    low, high = 4 * n // 5, n // 5  # differences of -1, and of 2
    minus, plus = low * (low + 1) / 2, high * low + high * (high + 1) / 2
    ties = low**3 - low + high**3 - high
    z = (plus - n * (n + 1) / 4 + 0.5) / np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert (r["n"], r["w_plus"], r["w_minus"]) == (n, plus, minus) and r["z"] == pytest.approx(z)


def test_kruskal_wallis_of_three_million_rows(spark):
    n = 3_000_000
    df = spark.range(n).select((F.col("id") % 1000).cast("double").alias("v"), (F.col("id") % 1000 < 400).alias("g"))
    r = statistics.kruskal_wallis(df, "v", "g").first()
    t = n // 1000
    low, high = 400 * t, 600 * t
    sums = low * (low + 1) / 2, n * (n + 1) / 2 - low * (low + 1) / 2
    h = (12 / (n * (n + 1)) * (sums[0] ** 2 / low + sums[1] ** 2 / high) - 3 * (n + 1)) / (1 - 1000 * (t**3 - t) / (n**3 - n))
    assert (r["n"], r["k"]) == (n, 2) and r["h"] == pytest.approx(h)


def test_value_set_pairs_are_made_from_lists_and_not_moved(spark, monkeypatch):
    monkeypatch.setattr(records, "LISTED", 10, raising=False)
    rows = [(i, "abc"[i % 3], "uvw"[i % 9 // 3], None if i % 5 else "z") for i in range(180)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string").repartition(3)
    sets = {r[0]: {v for v in r[1:] if v} for r in rows}
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    pairs = records.value_set_pairs(df, "id", ["a", "b", "c"], 0.5)
    got = pairs.collect()
    assert {(r["a"], r["b"]): r["jaccard"] for r in got} == pytest.approx({k: v for k, v in alike.items() if v >= 0.5}) and len(got) == sum(v >= 0.5 for v in alike.values())
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
