"""Exact quantiles of whole columns without one task that holds all distinct values.

An approximate quantile of bounded rank error on either side brackets each exact one; a second pass counts the rows below and within each
bracket, and a third finds the wanted ranks among the few values within it. All columns and quantiles share the three passes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sketch's rank error is one in ACCURACY; brackets reach SLACK such errors to either side.
ACCURACY, SLACK = 10_000, 3


def exact_quantiles(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], at: Sequence[float]) -> dict[str, list[float | None]]:
    """Of each column, its quantiles at shares `at` of the rows that are not null, interpolated between neighbours; nulls where there are no rows."""
    given = {c: F.col(c) for c in columns} if not isinstance(columns, Mapping) else dict(columns)
    names = [f"c{i}" for i in range(len(given))]
    rows = df.select(*(x.cast("double").alias(n) for n, x in zip(names, given.values(), strict=True)))
    places = sorted({min(1.0, max(0.0, q + s * SLACK / ACCURACY)) for q in at for s in (-1, 1)})
    first = rows.agg(*(e for n in names for e in (F.count(n), F.min(n), F.max(n), F.percentile_approx(n, places, ACCURACY)))).first()
    brackets: dict[tuple[str, float], tuple] = {}
    for i, n in enumerate(names):
        size, low, high, found = first[4 * i : 4 * i + 4]
        for q in at if size else ():
            lo, hi = (found[places.index(min(1.0, max(0.0, q + s * SLACK / ACCURACY)))] for s in (-1, 1))
            brackets[n, q] = (size, low if q <= SLACK / ACCURACY else lo, high if q >= 1 - SLACK / ACCURACY else hi, low, high)
    if not brackets:
        return {c: [None] * len(at) for c in given}
    keys = list(brackets)
    counts = rows.agg(*(e for n, q in keys for e in (F.count_if(F.col(n) < F.lit(brackets[n, q][1])), F.count_if(F.col(n) <= F.lit(brackets[n, q][2]))))).first()
    wanted, asked = {}, []
    for i, (n, q) in enumerate(keys):
        size, lo, hi, low, high = brackets[n, q]
        below, within = counts[2 * i], counts[2 * i + 1] - counts[2 * i]
        place = q * (size - 1)
        k = math.floor(place + 1e-9)
        after = min(size - 1, k + 1)
        if not (below <= k and after < below + within):  # the bracket missed: all values
            lo, hi, below, within = low, high, 0, size
        share = lambda r: min(1.0, max(0.0, (r - below) / (within - 1))) if within > 1 else 0.0  # noqa: B023, E731
        x = F.when(F.col(n).between(F.lit(lo), F.lit(hi)), F.col(n))
        wanted[n, q] = max(0.0, place - k)
        asked.append(F.percentile(x, F.array(F.lit(share(k)), F.lit(share(after)))))
    values = dict(zip(keys, rows.agg(*asked).first(), strict=True))
    out = {}
    for c, n in zip(given, names, strict=True):
        out[c] = [values[n, q][0] + wanted[n, q] * (values[n, q][1] - values[n, q][0]) if (n, q) in values and wanted[n, q] > 1e-9 else values[n, q][0] if (n, q) in values else None for q in at]
    return out
