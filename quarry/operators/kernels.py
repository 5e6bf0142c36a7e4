"""Series kernels that SQL cannot say: numpy functions on one key's ordered values, run by applyInPandas.

A key's series must fit in one task; keys are dealt over tasks. Series too short for a kernel give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_series(df: DataFrame, key: str, order: Sequence[str], value: str, kernels: dict[str, Callable[[np.ndarray], float | None]]) -> DataFrame:
    """(key, a double for each kernel)."""
    schema = f"{key} {dict(df.dtypes)[key]}, " + ", ".join(f"{k} double" for k in kernels)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values(list(order))[value].dropna().to_numpy(float)
        return pd.DataFrame([[part[key].iloc[0], *(f(x) for f in kernels.values())]], columns=[key, *kernels])

    return df.select(key, *order, value).groupBy(key).applyInPandas(run, schema)


def transformed(df: DataFrame, key: str, order: Sequence[str], value: str, f: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """The rows with f of the whole ordered series beside them."""
    keep = [key, *order, value]
    schema = ", ".join(f"{c} {t}" for c, t in df.select(*keep).dtypes) + f", {name} double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(order))
        return part.assign(**{name: f(part[value].to_numpy(float))})[[*keep, name]]

    return df.select(*keep).groupBy(key).applyInPandas(run, schema)


def holt(alpha: float, beta: float = 0.0) -> Callable[[np.ndarray], np.ndarray]:
    """Level and trend smoothing: one-step fitted levels."""

    def f(x: np.ndarray) -> np.ndarray:
        out, level, trend = np.empty(len(x)), x[0] if len(x) else 0.0, 0.0
        for i, v in enumerate(x):
            before = level
            level = v if i == 0 else alpha * v + (1 - alpha) * (level + trend)
            trend = beta * (level - before) + (1 - beta) * trend
            out[i] = level
        return out

    return f


def holt_winters(alpha: float, beta: float, gamma: float, period: int) -> Callable[[np.ndarray], np.ndarray]:
    """Additive season: one-step forecasts; NaN over the first period."""

    def f(x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        if len(x) <= period:
            return out
        level, trend = x[:period].mean(), 0.0
        season = list(x[:period] - level)
        for i in range(period, len(x)):
            s = season[i % period]
            out[i] = level + trend + s
            before = level
            level = alpha * (x[i] - s) + (1 - alpha) * (level + trend)
            trend = beta * (level - before) + (1 - beta) * trend
            season[i % period] = gamma * (x[i] - level) + (1 - gamma) * s
        return out

    return f


def median_filter(size: int) -> Callable[[np.ndarray], np.ndarray]:
    def f(x: np.ndarray) -> np.ndarray:
        if not len(x):
            return x
        padded = np.pad(x, size // 2, mode="symmetric")
        return np.median(np.lib.stride_tricks.sliding_window_view(padded, size), axis=1)[: len(x)]

    return f


def savitzky_golay(size: int, degree: int) -> Callable[[np.ndarray], np.ndarray]:
    """Least-squares polynomials over centred windows; the ends use the first and last whole window."""

    def f(x: np.ndarray) -> np.ndarray:
        if len(x) < size:
            return np.full(len(x), np.nan)
        at = np.arange(size) - size // 2
        hat = np.vander(at, degree + 1, increasing=True) @ np.linalg.pinv(np.vander(at, degree + 1, increasing=True))
        views = np.lib.stride_tricks.sliding_window_view(x, size)
        half = size // 2
        return np.concatenate([(hat @ views[0])[:half], views @ hat[half], (hat @ views[-1])[half + 1 :]])

    return f


def hurst(x: np.ndarray, least: int = 10) -> float | None:
    """Slope of ln(R/S) on ln(lag)."""
    if len(x) < 2 * least:
        return None
    lags = np.unique(np.logspace(math.log10(least), math.log10(len(x) // 2), 12).astype(int))
    points = []
    for lag in lags:
        parts = x[: len(x) // lag * lag].reshape(-1, lag)
        dev = np.cumsum(parts - parts.mean(axis=1, keepdims=True), axis=1)
        s = parts.std(axis=1)
        rs = ((dev.max(axis=1) - dev.min(axis=1))[s > 0] / s[s > 0]).mean() if (s > 0).any() else 0
        if rs > 0:
            points.append((math.log(lag), math.log(rs)))
    return float(np.polyfit(*zip(*points, strict=True), 1)[0]) if len(points) > 1 else None


def sample_entropy(m: int = 2, r: float = 0.2) -> Callable[[np.ndarray], float | None]:
    """-ln of the share of pairs of stretches of m + 1 values that lie within r deviations, over that of m values; each share is of its own
    number of pairs (len - m of the longer ones, len - m + 1 of the shorter). 0 where there are no such pairs."""

    def f(x: np.ndarray) -> float | None:
        if len(x) < m + 2 or x.std() == 0:
            return 0.0 if len(x) and x.std() == 0 else None
        tolerance = r * x.std()

        def share(k: int) -> float:
            v = np.lib.stride_tricks.sliding_window_view(x, k)
            near = sum(int((np.abs(v[i + 1 :] - v[i]).max(axis=1) <= tolerance).sum()) for i in range(len(v) - 1))
            return 2 * near / (len(v) * (len(v) - 1))

        a, b = share(m + 1), share(m)
        return -math.log(a / b) if a and b else 0.0

    return f


def permutation_entropy(m: int = 3) -> Callable[[np.ndarray], float | None]:
    def f(x: np.ndarray) -> float | None:
        if len(x) < m:
            return None
        order = np.argsort(np.lib.stride_tricks.sliding_window_view(x, m), axis=1, kind="stable")
        _, c = np.unique(order, axis=0, return_counts=True)
        p = c / c.sum()
        return float(-(p * np.log(p)).sum() / math.log(math.factorial(m)))

    return f


def spectral_centroid(x: np.ndarray) -> float | None:
    if len(x) < 2:
        return None
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    return float((np.fft.rfftfreq(len(x)) * power).sum() / power.sum()) if power.sum() else 0.0


def dominant_period(x: np.ndarray) -> float | None:
    if len(x) < 4:
        return None
    power = np.abs(np.fft.rfft(x - x.mean()))[1:]
    return float(len(x) / (int(power.argmax()) + 1))


def ar_coefficient(x: np.ndarray) -> float | None:
    """First-order autoregression by Yule and Walker."""
    d = x - x.mean() if len(x) else x
    return float((d[1:] * d[:-1]).sum() / (d * d).sum()) if len(x) > 2 and (d * d).sum() else None


def pettitt(x: np.ndarray) -> float | None:
    """Place of the most likely change: the largest |U| of rank sums."""
    n = len(x)
    if n < 2:
        return None
    ranks = pd.Series(x).rank().to_numpy()
    u = 2 * np.cumsum(ranks) - np.arange(1, n + 1) * (n + 1)
    return float(np.abs(u).argmax() + 1)


def mann_kendall(x: np.ndarray) -> float | None:
    """z of the trend test."""
    n = len(x)
    if n < 3:
        return None
    s = sum(int(np.sign(x[i + 1 :] - x[i]).sum()) for i in range(n - 1))
    return float((s - np.sign(s)) / math.sqrt(n * (n - 1) * (2 * n + 5) / 18))


def binary_segmentation(penalty: float, least: int = 5) -> Callable[[np.ndarray], float]:
    """How many cuts lower the squared error by more than the penalty."""

    def f(x: np.ndarray) -> float:
        def cost(a: int, b: int) -> float:
            return float(((x[a:b] - x[a:b].mean()) ** 2).sum())

        todo, cuts = [(0, len(x))], 0
        while todo:
            a, b = todo.pop()
            if b - a < 2 * least:
                continue
            whole = cost(a, b)
            gain, at = max((whole - cost(a, k) - cost(k, b), k) for k in range(a + least, b - least + 1))
            if gain > penalty:
                cuts += 1
                todo += [(a, at), (at, b)]
        return float(cuts)

    return f


def smoothed_line(x: np.ndarray, width: int, degree: int = 1, weights: np.ndarray | None = None) -> np.ndarray:
    """Locally weighted lines: at each place a fit to its `width` nearest places, with tricube weights."""
    n = len(x)
    width, out, places = min(width, n), np.empty(n), np.arange(n)
    for i in range(n):
        lo = min(max(0, i - width // 2), n - width)
        t = places[lo : lo + width] - i
        w = np.clip(1 - np.abs(t / (np.abs(t).max() + 1.0)) ** 3, 0, None) ** 3
        w = w * (weights[lo : lo + width] if weights is not None else 1)
        a = np.vander(t, degree + 1, increasing=True).astype(float)
        aw = a * w[:, None]
        out[i] = np.linalg.lstsq(aw.T @ a, aw.T @ x[lo : lo + width], rcond=None)[0][0]
    return out


def seasonal_trend(x: np.ndarray, period: int, season_width: int = 7, trend_width: int | None = None, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, season, rest) by local lines: the season from each phase's own series, less its running means; the trend from what is left."""
    n = len(x)
    trend, season = np.zeros(n), np.zeros(n)
    if n < 2 * period:
        return np.full(n, x.mean() if n else 0.0), season, x - (x.mean() if n else 0.0)
    trend_width = trend_width or int(1.5 * period / (1 - 1.5 / season_width)) | 1

    def run(v: np.ndarray, k: int) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(v)])
        half = k // 2
        lo, hi = np.maximum(0, np.arange(len(v)) - half), np.minimum(len(v), np.arange(len(v)) - half + k)
        return (sums[hi] - sums[lo]) / (hi - lo)

    for _ in range(rounds):
        left = x - trend
        cycle = np.empty(n)
        for phase in range(period):
            cycle[phase::period] = smoothed_line(left[phase::period], season_width)
        season = cycle - smoothed_line(run(run(cycle, period), 3), trend_width)
        trend = smoothed_line(x - season, trend_width)
    return trend, season, x - trend - season


def break_in_unit_root(x: np.ndarray, trim: float = 0.15, lags: int = 1) -> float | None:
    """The least t of rho - 1 over all places of a shift in level: a unit root against one break at an unknown place."""
    n = len(x)
    d = np.diff(x)
    if n < 12 + lags or x.std() == 0:
        return None
    best = None
    t = np.arange(lags + 1, n)
    base = [np.ones(len(t)), t.astype(float), x[t - 1], *(d[t - 1 - j] for j in range(1, lags + 1))]
    for cut in range(max(lags + 2, int(trim * n)), min(n - 2, int((1 - trim) * n)) + 1):
        a = np.column_stack([*base, (t >= cut).astype(float)])
        inverse = np.linalg.pinv(a.T @ a)
        b = inverse @ (a.T @ d[t - 1])
        free = len(t) - a.shape[1]
        if free <= 0:
            return None
        e = d[t - 1] - a @ b
        s = math.sqrt(max(1e-300, float(e @ e) / free * inverse[2, 2]))
        best = float(b[2] / s) if best is None else min(best, float(b[2] / s))
    return best


def seasonal_ar(period: int, order: int = 1, seasonal: int = 1, difference: int = 0, seasonal_difference: int = 0):
    """One-step forecasts of a seasonal autoregression (lags 1 to order, and period to seasonal * period) of the differenced series, fitted by least squares."""

    def f(x: np.ndarray) -> np.ndarray:
        v, undo = x.astype(float), []
        for lag, times in ((period, seasonal_difference), (1, difference)):
            for _ in range(times):
                undo.append((lag, v))
                v = np.concatenate([np.full(min(lag, len(v)), np.nan), v[lag:] - v[:-lag]]) if len(v) > lag else np.full(len(v), np.nan)
        lags = sorted({*range(1, order + 1), *(period * i for i in range(1, seasonal + 1))})
        out = np.full(len(x), np.nan)
        rows = np.arange(lags[-1], len(v)) if len(v) > lags[-1] else np.zeros(0, int)
        if not len(rows):
            return out
        a = np.column_stack([np.ones(len(rows)), *(v[rows - k] for k in lags)])
        ok = np.isfinite(a).all(axis=1) & np.isfinite(v[rows])
        if ok.sum() <= a.shape[1]:
            return out
        b = np.linalg.lstsq(a[ok], v[rows][ok], rcond=None)[0]
        out[rows] = a @ b
        for lag, before in reversed(undo):
            out[lag:] += before[:-lag]
        return out

    return f


def shapiro_wilk(x: np.ndarray) -> tuple[float, float] | None:
    """(W, p) of 3 to 5000 values, after Royston's approximations."""
    from quarry.functions.special import norm_ppf, norm_sf

    n = len(x)
    x = np.sort(x.astype(float))
    if not 3 <= n <= 5000 or x[-1] == x[0]:
        return None
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        mm, u = float(m @ m), 1 / math.sqrt(n)
        c = m / math.sqrt(mm)
        # Royston's polynomials for the two outermost weights.
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u) + c[-1]
        a = np.empty(n)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u) + c[-2]
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[1], a[-2] = -second, second
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[0], a[-1] = -last, last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if n <= 11:
        g = -2.273 + 0.459 * n
        z = -math.log(g - math.log(max(1e-300, 1 - w)))
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        z, k = math.log(max(1e-300, 1 - w)), math.log(n)
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return w, norm_sf((z - mu) / sigma)


def time_warped(knots: int = 4, strength: float = 0.2, seed: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """The series read at places that run faster and slower: steps between knots are drawn around one, the ends stay."""

    def f(x: np.ndarray) -> np.ndarray:
        if len(x) < 3:
            return x
        speed = np.exp(strength * np.random.default_rng(seed).standard_normal(knots + 1))
        at = np.concatenate([[0.0], np.cumsum(speed)])
        way = np.interp(np.linspace(0, knots + 1, len(x)), np.arange(knots + 2), at / at[-1]) * (len(x) - 1)
        return np.interp(way, np.arange(len(x)), x)

    return f


def jittered(noise: float = 0.05, scale: float = 0.1, seed: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """The series times a number near one, with normal noise of a share of its deviation."""

    def f(x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return x * (1 + scale * rng.standard_normal()) + noise * (x.std() if len(x) else 0.0) * rng.standard_normal(len(x))

    return f
