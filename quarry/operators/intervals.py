"""Bins chosen by the values or by a 0/1 target: one-dimensional k-means, monotonic and optimal cuts.

The driver holds the counts of at most `start` fine bins, whatever the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.binning import digitize, quantile_edges


def k_means_edges(df: DataFrame, column: str, n: int, rounds: int = 50, tolerance: float = 1e-6) -> list[float]:
    """Ends, and the middles between the centres of k-means on one column, started at its quantiles."""
    from quarry.operators.clusters import Centres, k_means

    x = F.col(column).cast("double")
    row = df.agg(F.min(x), F.max(x), F.percentile_approx(x, [(i + 0.5) / n for i in range(n)], 10_000)).first()
    start = Centres((column,), tuple((v,) for v in sorted(set(row[2]))))
    centres = sorted(p[0] for p in k_means(df, start, rounds, tolerance).points)
    return [row[0], *((a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)), row[1]]


def fine_counts(df: DataFrame, column: str, target: str, start: int) -> tuple[list[float], list[tuple[int, float]]]:
    """Edges of at most `start` approximate quantile bins, and of each bin its rows and its sum of the target."""
    edges = quantile_edges(df, column, start, exact=False)
    if len(edges) == 1:
        edges = edges * 2
    t = df.where(F.col(column).isNotNull() & F.col(target).isNotNull()).groupBy(digitize(F.col(column).cast("double"), edges).alias("b")).agg(F.count("*").alias("n"), F.sum(F.col(target).cast("double")).alias("y"))
    found = {r["b"]: (r["n"], r["y"]) for r in t.collect()}
    return edges, [found.get(i, (0, 0.0)) for i in range(len(edges) - 1)]


def pooled_bins(cells: Sequence[tuple[int, float]], least: int = 1, increasing: bool = True) -> list[int]:
    """Positions at which bins begin, after neighbours whose means are out of order, or which have fewer than `least` rows, are pooled."""
    sign = 1 if increasing else -1
    out: list[list[float]] = []  # begin, rows, sum
    for i, (n, y) in enumerate(cells):
        out.append([i, n, y])
        while len(out) > 1 and (out[-2][1] < least or out[-1][1] == 0 or out[-2][1] == 0 or sign * out[-2][2] / out[-2][1] >= sign * out[-1][2] / out[-1][1]):
            _, n2, y2 = out.pop()
            out[-1][1] += n2
            out[-1][2] += y2
    while len(out) > 1 and out[-1][1] < least:
        _, n2, y2 = out.pop()
        out[-1][1] += n2
        out[-1][2] += y2
    return [int(b[0]) for b in out]


def monotonic_edges(df: DataFrame, column: str, target: str, start: int = 20, least: int = 1) -> list[float]:
    """Cuts between which the target's mean only rises, or only falls, whichever leaves more bins."""
    edges, cells = fine_counts(df, column, target, start)
    best = max((pooled_bins(cells, least, up) for up in (True, False)), key=len)
    return [edges[i] for i in best] + edges[-1:]


def information(cells: Sequence[tuple[int, float]]) -> float:
    """Information value of bins (rows, events), half a count added to each."""
    good, bad = sum(n - y for n, y in cells) + 0.5, sum(y for _, y in cells) + 0.5
    out = 0.0
    for n, y in cells:
        g, b = (n - y + 0.5) / good, (y + 0.5) / bad
        out += (g - b) * math.log(g / b)
    return out


def gini_gain(cells: Sequence[tuple[int, float]]) -> float:
    """How far the bins lower the Gini impurity of the whole."""
    n, y = sum(c[0] for c in cells), sum(c[1] for c in cells)
    impurity = lambda m, k: 2 * (k / m) * (1 - k / m) if m else 0.0
    return impurity(n, y) - sum(m / n * impurity(m, k) for m, k in cells) if n else 0.0


def optimal_edges(df: DataFrame, column: str, target: str, most: int = 5, start: int = 50, least: int = 1, objective: str = "information", penalty: float = 0.0, monotonic: bool = False) -> list[float]:
    """Greedy cuts of a 0/1 target: the one that adds most to the objective, each time, while it adds more than `penalty`."""
    value = {"information": information, "gini": gini_gain}[objective]
    edges, cells = fine_counts(df, column, target, start)
    cuts: list[int] = []

    def joined(places: Sequence[int]) -> list[tuple[int, float]]:
        ends = [0, *sorted(places), len(cells)]
        return [(sum(c[0] for c in cells[a:b]), sum(c[1] for c in cells[a:b])) for a, b in zip(ends, ends[1:], strict=False)]

    while len(cuts) + 1 < most:
        now, best = value(joined(cuts)), None
        for i in range(1, len(cells)):
            if i not in cuts:
                parts = joined([*cuts, i])
                if min(n for n, _ in parts) >= least:
                    gain = value(parts) - now - penalty
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-15):
                        best = (gain, i)
        if best is None:
            break
        cuts.append(best[1])
    if monotonic:
        begin = [0, *sorted(cuts)]
        kept = max((pooled_bins(joined(cuts), least, up) for up in (True, False)), key=len)
        cuts = [begin[i] for i in kept if i]
    return [edges[0], *(edges[i] for i in sorted(cuts)), edges[-1]]
