"""Points that lie near (or far from) others, by boxes: the meetings on which neighbours and clusters rest.

Distinct query points are dealt to boxes of about BOX by a tree of cuts. A row goes to the boxes whose points it can concern, by its least and
greatest distance to the box, so no pair that matters is left out, and few others meet. Within a meeting boxes are halved again, and rows
turned away again, until LEAF queries are left, whose distances are computed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators._store import stored

#: Query points of a box and of a leaf, rows of a meeting, rows from which the bounds of boxes are taken, rows packed at once, cells of a matrix of distances.
BOX, LEAF, PART, DRAWN, PACK, CELLS = 4096, 64, 200_000, 65_536, 65_536, 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def drawn(df: DataFrame, names: Sequence[str], n: int) -> np.ndarray:
    """DRAWN of n rows or so, by a hash: they only place cuts and give bounds, which hold for any rows."""
    found = df.where(F.pmod(F.xxhash64(*df.columns), F.lit(max(1, n // DRAWN))) == 0).select(*names).toArrow()
    return np.stack([found[c].to_numpy() for c in names], axis=1) if found.num_rows else np.zeros((0, len(names)))


def widest(x: np.ndarray) -> int:
    with np.errstate(invalid="ignore"):
        return int(np.argmax(np.nan_to_num(x.max(0) - x.min(0), nan=0.0, posinf=1e308)))


def cuts(x: np.ndarray, boxes: int, first: int = 0) -> tuple | int:
    """(axis, cut, below, from there on), nested; a box is a number."""
    axis = widest(x) if len(x) else 0
    if boxes < 2 or len(x) < 2 or not x[:, axis].min() < x[:, axis].max():
        return first
    at = np.partition(x[:, axis], len(x) // 2)[len(x) // 2]
    at = at if (x[:, axis] < at).any() else x[x[:, axis] > at, axis].min()
    low = x[:, axis] < at
    left = min(boxes - 1, max(1, round(boxes * low.mean())))
    return axis, at, cuts(x[low], left, first), cuts(x[~low], boxes - left, first + left)


def box_of(tree: tuple | int, x: np.ndarray) -> np.ndarray:
    out, todo = np.zeros(len(x), np.int32), [(tree, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if isinstance(node, int):
            out[at] = node
        elif len(at):
            low = x[at, node[0]] < node[1]
            todo += [(node[2], at[low]), (node[3], at[~low])]
    return out


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Of all of a to all of b: euclidean, squared or manhattan."""
    d = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = b[:, j] - a[:, j, None]
        d += np.abs(gap) if metric == "manhattan" else gap * gap
    return np.sqrt(d) if metric == "euclidean" else d


def reach(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest distance of each row to a box, rounded as `distances` rounds, so that no distance lies outside."""
    low, high = np.zeros(len(x)), np.zeros(len(x))
    for j in range(x.shape[1]):
        below, above = lo[j] - x[:, j], x[:, j] - hi[j]
        near, far = np.fmax(np.fmax(below, above), 0.0), np.maximum(np.abs(below), np.abs(above))
        low, high = (low + near, high + far) if metric == "manhattan" else (low + near * near, high + far * far)
    return (np.sqrt(low), np.sqrt(high)) if metric == "euclidean" else (low, high)


def halves(q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, mid = np.argpartition(q[at, widest(q[at])], len(at) // 2), len(at) // 2
    return at[order[:mid]], at[order[mid:]]


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, metric: str, farthest: bool = False, within: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, key, id) of the k rows of least key for each query, in order; the key is the distance, or less it if `farthest`; ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    x, ids, found = x[order], ids[order], []
    todo = [(np.arange(len(q)), np.arange(len(x)))] if len(q) and len(x) else []
    while todo:
        at, near = todo.pop()
        low, high = reach(x[near], q[at].min(0), q[at].max(0), metric)
        low, high = (-high, -low) if farthest else (low, high)
        cut = np.partition(high, k - 1)[k - 1] if len(near) > k else np.inf
        near = near[~((low > cut) | (low > within))]
        if len(at) > LEAF and len(near):
            todo += [(half, near) for half in halves(q, at)]
            continue
        step = max(1, CELLS // max(1, len(near)))
        for some in (at[i : i + step] for i in range(0, len(at), step)):
            d = distances(q[some], x[near], metric)
            d = -d if farthest else d
            d[np.isnan(d)] = np.inf
            some_cut = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(near) > k else np.inf
            i, j = np.nonzero((d <= some_cut) & (d < np.inf) & (d <= within))
            key = d[i, j]
            order = np.lexsort((j, key, i))
            i, j, key = i[order], j[order], key[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((some[i[kept]], key[kept], ids[near[j[kept]]]))
    places, keys, rows = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    order = np.argsort(places, kind="stable")
    return places[order], keys[order], rows[order]


def packs(names: Sequence[str], carried: Sequence[str], deal: Callable):
    """For mapInArrow: deal(points, numbers) gives (box, part, places of its rows), each of which is one row with packed matrices."""

    def pack(batches):
        def dealt(held):
            t = pa.Table.from_batches(held)
            x = np.stack([t[c].to_numpy() for c in names], axis=1)
            n = np.stack([t[c].to_numpy() for c in carried], axis=1) if carried else np.zeros((len(x), 0), np.int64)
            for box, part, at in deal(x, n):
                lo, hi = x[at].min(0).tolist(), x[at].max(0).tolist()
                yield pa.RecordBatch.from_pydict({"box": pa.array([box], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([len(at)], pa.int64()), "lo": [lo], "hi": [hi], "x": [x[at].tobytes()], "c": [n[at].tobytes()]})

        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= PACK:
                yield from dealt(held)
                held, size = [], 0
        if size:
            yield from dealt(held)

    return pack


PACKED = "box int, part int, n long, lo array<double>, hi array<double>, x binary, c binary"


def met(rows: DataFrame, queries: DataFrame, names: Sequence[str], rows_carry: Sequence[str], queries_carry: Sequence[str], kernel: Callable, schema: str, metric: str, k: int | None = None, farthest: bool = False, within: float = np.inf) -> tuple[DataFrame, bool]:
    """kernel(q, qc, x, xc) -> table, on the points and carried numbers of each box and of the rows that it concerns; and whether each box meets all its rows at once.

    Rows are stored tables; queries hold distinct points. A row concerns a box if it can be among the k nearest (farthest) of a point of it, or within `within` of one.
    """
    d, n_queries, n_rows = len(names), queries.count(), rows.count()
    tree = cuts(drawn(queries, names, n_queries), -(-n_queries // BOX))

    def deal(x, n):
        box = box_of(tree, x)
        order = np.argsort(box, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(box[order])) + 1):
            yield int(box[at[0]]), 0, at

    asked = stored(queries.select(*names, *queries_carry).mapInArrow(packs(names, queries_carry, deal), PACKED), "boxes")
    ends = asked.groupBy("box").agg(*(F.min(F.col("lo")[j]) for j in range(d)), *(F.max(F.col("hi")[j]) for j in range(d))).collect()
    boxes, some = [], drawn(rows, names, n_rows)
    for row in ends:
        lo, hi = np.array(row[1 : d + 1]), np.array(row[d + 1 :])
        low, high = reach(some, lo, hi, metric)
        low, high = (-high, -low) if farthest else (low, high)
        limit = within if k is None or len(some) < k else min(within, np.partition(high, k - 1)[k - 1])
        share = (~(low > limit)).mean() if len(some) else 0.0
        boxes.append((row["box"], lo, hi, limit, max(1, int(np.ceil(share * n_rows / PART)))))

    def concern(x, n):
        for box, lo, hi, limit, parts in boxes:
            low, high = reach(x, lo, hi, metric)
            at = np.flatnonzero(~((-high if farthest else low) > limit))
            part = (n[at, 0].astype(np.uint64) * MIX >> np.uint64(33)) % np.uint64(parts)
            for p in range(parts):
                if (own := at[part == p]).size:
                    yield box, p, own

    given = rows.select(*names, *rows_carry).mapInArrow(packs(names, rows_carry, concern), PACKED)
    most = max((b[-1] for b in boxes), default=1)
    if most > 1:
        parts = rows.sparkSession.createDataFrame([(int(b[0]), int(b[-1])) for b in boxes], "box int, parts int")
        asked = asked.join(parts, "box").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def opened(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
        x, c = (b"".join(t[name].to_pylist()) for name in ("x", "c"))
        x = np.frombuffer(x).reshape(-1, d)
        return x, np.frombuffer(c, np.int64).reshape(len(x), width)

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return kernel(*opened(left, len(queries_carry)), *opened(right, len(rows_carry)))

    return asked.groupBy("box", "part").cogroup(given.groupBy("box", "part")).applyInArrow(meet, schema), most == 1


def best_rows(rows: DataFrame, points: DataFrame, names: Sequence[str], k: int, metric: str, farthest: bool = False, within: float = np.inf) -> DataFrame:
    """(names, near): for each distinct point its k nearest (farthest) rows (id, names) as (key, id) in order; see `best`."""
    kind = pa.list_(pa.struct([("key", pa.float64()), ("id", pa.int64())]))

    def kernel(q, _, x, carried):
        place, key, ids = best(q, x, carried[:, 0], k, metric, farthest, within)
        offsets = np.searchsorted(place, np.arange(len(q) + 1)).astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(key), pa.array(ids)], ["key", "id"]), type=kind)
        return pa.table([*(pa.array(q[:, j]) for j in range(len(names))), near], names=[*names, "near"])

    found, whole = met(rows, points, names, ["id"], [], kernel, ", ".join(f"{c} double" for c in names) + ", near array<struct<key: double, id: bigint>>", metric, k, farthest, within)
    return found if whole else found.groupBy(*names).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def touch(q: np.ndarray, x: np.ndarray, within: float) -> bool:
    """Whether a row of q and one of x are within (squared)."""
    todo = [(np.arange(len(q)), np.arange(len(x)))]
    while todo:
        at, near = todo.pop()
        low, high = reach(x[near], q[at].min(0), q[at].max(0), "squared")
        if (high <= within).any():
            return True
        near = near[low <= within]
        if len(at) > LEAF and len(near):
            todo += [(half, near) for half in halves(q, at)]
        elif any((distances(q[at], x[near[i : i + LEAF * LEAF]], "squared") <= within).any() for i in range(0, len(near), LEAF * LEAF)):
            return True
    return False


def by_cell(x: np.ndarray, s: float) -> dict[tuple[int, int], np.ndarray]:
    cell = np.floor(x / s).astype(np.int64)
    order = np.lexsort((cell[:, 1], cell[:, 0]))
    cell = cell[order]
    starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)]) if len(x) else []
    return {(int(cell[a, 0]), int(cell[a, 1])): x[rows] for a, rows in zip(starts, np.split(order, starts[1:]) if len(x) else [], strict=True)}


def close_cells(points: DataFrame, eps: float) -> tuple[DataFrame, float]:
    """Distinct points (x, y) -> (ai, aj, bi, bj), cells of which two points are within eps, and the cells' side, so small that all points of a cell are."""
    s = eps / 2**0.5 * (1 - 1e-6)
    around = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0)]

    def kernel(q, _, x, __):
        rows, found = by_cell(x, s), []
        for (i, j), own in by_cell(q, s).items():
            found += [(i, j, i + di, j + dj) for di, dj in around if (others := rows.get((i + di, j + dj))) is not None and touch(own, others, eps * eps)]
        return pa.table([pa.array([f[c] for f in found], pa.int64()) for c in range(4)], names=["ai", "aj", "bi", "bj"])

    return met(points, points, ["x", "y"], ["id"], [], kernel, "ai long, aj long, bi long, bj long", "squared", within=eps * eps)[0].distinct(), s


def weights_within(points: DataFrame, within: float) -> DataFrame:
    """Distinct points (x, y, id, w) -> (x, y, n): the weight of the points within a distance, whose square is `within`."""

    def kernel(q, _, x, carried):
        w, n = carried[:, 1], np.zeros(len(q), np.int64)
        todo = [(np.arange(len(q)), np.arange(len(x)))] if len(q) else []
        while todo:
            at, near = todo.pop()
            low, high = reach(x[near], q[at].min(0), q[at].max(0), "squared")
            n[at] += w[near[high <= within]].sum()
            near = near[(low <= within) & (high > within)]
            if len(at) > LEAF and len(near):
                todo += [(half, near) for half in halves(q, at)]
                continue
            step = LEAF * LEAF
            for some in (near[i : i + step] for i in range(0, len(near), step)):
                n[at] += (distances(q[at], x[some], "squared") <= within) @ w[some]
        return pa.table([q[:, 0], q[:, 1], n], names=["x", "y", "n"])

    found, whole = met(points, points.select("x", "y"), ["x", "y"], ["id", "w"], [], kernel, "x double, y double, n long", "squared", within=within)
    return found if whole else found.groupBy("x", "y").agg(F.sum("n").alias("n"))


def next_higher(points: DataFrame, within: float) -> DataFrame:
    """Distinct points (x, y, id, n) -> (id, to): the nearest point of higher n (at equal n, of smaller id) within a distance, whose square is `within`; ties to the
    smaller id; itself where there is none."""

    def kernel(q, qc, x, xc):
        order = np.argsort(xc[:, 0], kind="stable")  # so that of equal distances the smaller id comes first
        x, xc = x[order], xc[order]
        both = np.concatenate([qc, xc])
        order = np.lexsort((-both[:, 0], both[:, 1]))
        place = np.empty(len(both), np.int64)
        place[order] = np.cumsum(np.r_[True, (both[order[1:]] != both[order[:-1]]).any(1)]) if len(both) else 0
        own, other = place[: len(q)], place[len(q) :]
        to, far = qc[:, 0].copy(), np.full(len(q), np.inf)
        todo = [(np.arange(len(q)), np.arange(len(x)))] if len(q) else []
        while todo:
            at, near = todo.pop()
            near = near[other[near] > own[at].min()]
            low, high = reach(x[near], q[at].min(0), q[at].max(0), "squared")
            cut = min(within, high[other[near] > own[at].max()].min(initial=np.inf))
            near = near[low <= cut]
            if not len(near):
                continue
            if len(at) > LEAF:
                todo += [(half, near) for half in halves(q, at)]
                continue
            step = max(1, CELLS // len(near))
            for some in (at[i : i + step] for i in range(0, len(at), step)):
                d = distances(q[some], x[near], "squared")
                d[(other[near] <= own[some, None]) | (d > within)] = np.inf
                j = d.argmin(1)
                far[some] = d[np.arange(len(some)), j]
                to[some] = np.where(far[some] < np.inf, xc[near[j], 0], to[some])
        return pa.table([qc[:, 0], far, to], names=["id", "far", "to"])

    found, whole = met(points, points, ["x", "y"], ["id", "n"], ["id", "n"], kernel, "id long, far double, to long", "squared", within=within)
    return (found if whole else found.groupBy("id").agg(F.min_by("to", F.struct("far", "to")).alias("to"))).select("id", "to")
