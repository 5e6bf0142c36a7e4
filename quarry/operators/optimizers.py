"""Minimisers over a few parameters, on the driver. An objective over data is one aggregate (see `distributed`), so data never come here."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = np.ndarray
Objective = Callable[[Vector], float]


def numeric_gradient(f: Objective, x: Vector, h: float = 1e-5, method: str = "central") -> Vector:
    x = np.asarray(x, float)
    out, base = np.empty(len(x)), None if method == "central" else f(x)
    for i in range(len(x)):
        e = np.zeros(len(x))
        e[i] = h
        out[i] = (f(x + e) - f(x - e)) / (2 * h) if method == "central" else (f(x + e) - base) / h if method == "forward" else (base - f(x - e)) / h
    return out


def descend(gradient: Callable[[Vector], Vector], start: Sequence[float], rule: str = "adam", rate: float = 0.05, rounds: int = 2000, tolerance: float = 1e-8) -> Vector:
    """Gradient steps: sgd, adagrad, rmsprop or adam."""
    x = np.array(start, float)
    m, v = np.zeros(len(x)), np.zeros(len(x))
    for i in range(1, rounds + 1):
        g = np.asarray(gradient(x), float)
        if np.linalg.norm(g) < tolerance:
            break
        if rule == "sgd":
            step = g
        elif rule == "adagrad":
            v += g * g
            step = g / (np.sqrt(v) + 1e-8)
        elif rule == "rmsprop":
            v = 0.9 * v + 0.1 * g * g
            step = g / (np.sqrt(v) + 1e-8)
        else:
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        x = x - rate * step
    return x


def bfgs(f: Objective, start: Sequence[float], gradient: Callable[[Vector], Vector] | None = None, rounds: int = 200, tolerance: float = 1e-8) -> Vector:
    """Quasi-Newton steps with a backtracking line search."""
    grad = gradient or (lambda x: numeric_gradient(f, x))
    x, h = np.array(start, float), np.eye(len(start))
    g = grad(x)
    for _ in range(rounds):
        if np.linalg.norm(g) < tolerance:
            break
        d = -h @ g
        if d @ g >= 0:
            h, d = np.eye(len(x)), -g
        t, fx = 1.0, f(x)
        while f(x + t * d) > fx + 1e-4 * t * (g @ d) and t > 1e-12:
            t /= 2
        s = t * d
        new = grad(x + s)
        y = new - g
        x, g = x + s, new
        if s @ y > 1e-12:
            rho, one = 1 / (s @ y), np.eye(len(x))
            h = (one - rho * np.outer(s, y)) @ h @ (one - rho * np.outer(y, s)) + rho * np.outer(s, s)
    return x


def evolve(f: Objective, dim: int, low: float, high: float, size: int = 30, rounds: int = 200, seed: int = 0) -> Vector:
    """Differential evolution."""
    rng = np.random.default_rng(seed)
    pop = rng.uniform(low, high, (size, dim))
    cost = np.array([f(p) for p in pop])
    for _ in range(rounds):
        for i in range(size):
            a, b, c = pop[rng.choice(size, 3, replace=False)]
            trial = np.where(rng.random(dim) < 0.9, a + 0.6 * (b - c), pop[i])
            value = f(trial)
            if value <= cost[i]:
                pop[i], cost[i] = trial, value
    return pop[cost.argmin()]


def swarm(f: Objective, dim: int, low: float, high: float, size: int = 30, rounds: int = 200, seed: int = 0) -> Vector:
    """Particles drawn to their own and to the common best."""
    rng = np.random.default_rng(seed)
    x, v = rng.uniform(low, high, (size, dim)), np.zeros((size, dim))
    own, cost = x.copy(), np.array([f(p) for p in x])
    for _ in range(rounds):
        top = own[cost.argmin()]
        v = 0.7 * v + 1.5 * rng.random((size, dim)) * (own - x) + 1.5 * rng.random((size, dim)) * (top - x)
        x = np.clip(x + v, low, high)
        now = np.array([f(p) for p in x])
        better = now < cost
        own[better], cost[better] = x[better], now[better]
    return own[cost.argmin()]


def cma(f: Objective, start: Sequence[float], sigma: float = 0.5, rounds: int = 200, seed: int = 0) -> Vector:
    """Evolution strategy that adapts a covariance."""
    rng = np.random.default_rng(seed)
    mean, n = np.array(start, float), len(start)
    lam = 4 + int(3 * math.log(n)) * 2
    mu = lam // 2
    w = np.log(mu + 0.5) - np.log(np.arange(1, mu + 1))
    w /= w.sum()
    eff = 1 / (w * w).sum()
    cc, cs = 4 / (n + 4), (eff + 2) / (n + eff + 5)
    c1, cmu = 2 / ((n + 1.3) ** 2 + eff), min(1 - 2 / ((n + 1.3) ** 2 + eff), 2 * (eff - 2 + 1 / eff) / ((n + 2) ** 2 + eff))
    damp, chi = 1 + cs, math.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n))
    cov, pc, ps = np.eye(n), np.zeros(n), np.zeros(n)
    for _ in range(rounds):
        values, basis = np.linalg.eigh(cov)
        root = basis @ np.diag(np.sqrt(np.maximum(values, 1e-20)))
        y = rng.standard_normal((lam, n)) @ root.T
        order = np.argsort([f(mean + sigma * step) for step in y])[:mu]
        step = w @ y[order]
        mean = mean + sigma * step
        ps = (1 - cs) * ps + math.sqrt(cs * (2 - cs) * eff) * (basis @ np.diag(1 / np.sqrt(np.maximum(values, 1e-20))) @ basis.T @ step)
        pc = (1 - cc) * pc + math.sqrt(cc * (2 - cc) * eff) * step
        cov = (1 - c1 - cmu) * cov + c1 * np.outer(pc, pc) + cmu * (y[order].T * w) @ y[order]
        sigma *= math.exp(cs / damp * (np.linalg.norm(ps) / chi - 1))
        if sigma < 1e-12:
            break
    return mean


def distributed(df: DataFrame, loss: Callable[[Sequence[Column]], Column], rows: str = "mean") -> Objective:
    """An objective that is an aggregate of a row's loss, given the parameters as literals."""
    take = F.avg if rows == "mean" else F.sum
    return lambda x: float(df.agg(take(loss([F.lit(float(v)) for v in x]))).first()[0])


def gamma_likelihood(df: DataFrame, value: str) -> tuple[float, float]:
    """(shape, scale) of greatest likelihood: only the mean and the mean logarithm of the data are needed."""
    mean, mean_log = df.where(F.col(value) > 0).agg(F.avg(value), F.avg(F.log(value))).first()
    s = math.log(mean) - mean_log
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    psi = lambda z: (math.lgamma(z + 1e-5) - math.lgamma(z - 1e-5)) / 2e-5
    for _ in range(50):
        slope = 1 / k - (psi(k + 1e-4) - psi(k - 1e-4)) / 2e-4
        k -= (math.log(k) - psi(k) - s) / slope
    return k, mean / k


def lbfgs(f: Objective, start: Sequence[float], gradient: Callable[[Vector], Vector] | None = None, memory: int = 8, rounds: int = 200, tolerance: float = 1e-8) -> Vector:
    """Quasi-Newton steps from the last few changes of point and gradient, with a backtracking line search."""
    grad = gradient or (lambda x: numeric_gradient(f, x))
    x, past = np.array(start, float), []
    g = grad(x)
    for _ in range(rounds):
        if np.linalg.norm(g) < tolerance:
            break
        d, used = -g, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            used.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(used), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        if d @ g >= 0:
            d, past = -g, []
        t, fx = 1.0, f(x)
        while f(x + t * d) > fx + 1e-4 * t * (g @ d) and t > 1e-12:
            t /= 2
        new = grad(x + t * d)
        s, y = t * d, new - g
        x, g = x + s, new
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
    return x
