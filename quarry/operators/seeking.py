"""Search of parameters on the driver: what is evaluated, at a budget if asked, is the caller's own Spark job.

All searches minimise; ties go to the point that came first.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Callable, Mapping, Sequence

import numpy as np

#: A space names, for each parameter, a list of choices, or a range (low, high) of floats, or (low, high, "int").
Space = Mapping[str, Sequence]


def check_space(space: Space) -> list[str]:
    """What is wrong with a space."""
    wrong = []
    for k, v in space.items():
        if isinstance(v, tuple):
            if len(v) not in (2, 3) or not v[0] < v[1] or (len(v) == 3 and v[2] != "int"):
                wrong.append(f"{k}: a range is (low, high) or (low, high, 'int') with low < high")
        elif not isinstance(v, (list, set, frozenset)) or not v:
            wrong.append(f"{k}: choices are a list that is not empty")
    return wrong


def drawn(space: Space, rng: random.Random) -> dict:
    out = {}
    for k, v in space.items():
        out[k] = rng.randint(v[0], v[1]) if isinstance(v, tuple) and len(v) == 3 else rng.uniform(v[0], v[1]) if isinstance(v, tuple) else rng.choice(list(v))
    return out


def successive_halving(points: Sequence[dict], evaluate: Callable[[dict, int], float], least: int = 1, most: int = 81, eta: int = 3) -> tuple[dict, float, list[tuple[dict, int, float]]]:
    """All points at the least budget, the best of every eta at eta times it, and so on. Gives the best point at the largest budget met, its value and the history."""
    history, budget, left = [], least, list(points)
    while True:
        scored = sorted(((evaluate(p, budget), i) for i, p in enumerate(left)), key=lambda x: (x[0], x[1]))
        history += [(left[i], budget, v) for v, i in scored]
        if len(left) <= 1 or budget * eta > most:
            return left[scored[0][1]], scored[0][0], history
        left = [left[i] for _, i in scored[: max(1, len(left) // eta)]]
        budget *= eta


def hyperband(space: Space, evaluate: Callable[[dict, int], float], most: int = 27, eta: int = 3, seed: int = 0) -> tuple[dict, float]:
    """Brackets of successive halving, from many points at small budgets to few at the largest."""
    rng, best = random.Random(seed), None
    top = int(math.log(most, eta) + 1e-9)
    for s in range(top, -1, -1):
        n = math.ceil((top + 1) * eta**s / (s + 1))
        point, value, _ = successive_halving([drawn(space, rng) for _ in range(n)], evaluate, max(1, most // eta**s), most, eta)
        if best is None or value < best[1]:
            best = (point, value)
    return best


def parzen(space: Space, evaluate: Callable[[dict], float], rounds: int = 40, start: int = 10, gamma: float = 0.25, candidates: int = 24, seed: int = 0) -> tuple[dict, float, list[tuple[dict, float]]]:
    """Tree-structured Parzen estimators: of candidates drawn near good points, the one whose density among good over that among bad points is largest is tried."""
    rng = random.Random(seed)
    history = [(p, evaluate(p)) for p in (drawn(space, rng) for _ in range(start))]

    def density(k: str, x: object, among: list[dict]) -> float:
        v = space[k]
        if not isinstance(v, tuple):
            return (sum(p[k] == x for p in among) + 1) / (len(among) + len(list(v)))
        width = max((v[1] - v[0]) / max(1, len(among)) ** 0.5 / 2, 1e-12)
        return sum(math.exp(-0.5 * ((x - p[k]) / width) ** 2) for p in among) / (len(among) * width) + 1e-12

    def near(k: str, good: list[dict]) -> object:
        v, center = space[k], rng.choice(good)[k]
        if not isinstance(v, tuple):
            return center if rng.random() < 0.8 else rng.choice(list(v))
        x = min(v[1], max(v[0], rng.gauss(center, (v[1] - v[0]) / max(1, len(good)) ** 0.5 / 2)))
        return round(x) if len(v) == 3 else x

    for _ in range(rounds - start):
        ordered = sorted(range(len(history)), key=lambda i: (history[i][1], i))
        cut = max(2, math.ceil(gamma * len(history)))
        good, bad = [history[i][0] for i in ordered[:cut]], [history[i][0] for i in ordered[cut:]] or [history[ordered[-1]][0]]
        tries = [{k: near(k, good) for k in space} for _ in range(candidates)]
        point = max(tries, key=lambda p: sum(math.log(density(k, p[k], good) / density(k, p[k], bad)) for k in space))
        history.append((point, evaluate(point)))
    best = min(history, key=lambda x: x[1])
    return best[0], best[1], history


def bayesian(evaluate: Callable[[Sequence[float]], float], low: Sequence[float], high: Sequence[float], rounds: int = 25, start: int = 6, candidates: int = 400, noise: float = 1e-6, seed: int = 0) -> tuple[list[float], float]:
    """A Gaussian process on the unit cube (squared exponential kernel, its width chosen by likelihood); the next point is that of largest expected improvement."""
    rng, lo, hi = np.random.default_rng(seed), np.array(low, float), np.array(high, float)
    x = rng.random((start, len(lo)))
    y = np.array([evaluate((lo + (hi - lo) * p).tolist()) for p in x])
    for _ in range(rounds - start):
        mean, scale = y.mean(), y.std() or 1.0
        z = (y - mean) / scale
        d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        best = None
        for width in (0.1, 0.2, 0.4, 0.8):
            k = np.exp(-d2 / (2 * width * width)) + noise * np.eye(len(x))
            try:
                chol = np.linalg.cholesky(k)
            except np.linalg.LinAlgError:
                continue
            a = np.linalg.solve(chol.T, np.linalg.solve(chol, z))
            like = -0.5 * z @ a - np.log(np.diag(chol)).sum()
            if best is None or like > best[0]:
                best = (like, width, chol, a)
        if best is None:
            break
        _, width, chol, a = best
        tries = np.concatenate([rng.random((candidates, len(lo))), np.clip(x[y.argmin()] + 0.05 * rng.standard_normal((candidates // 4, len(lo))), 0, 1)])
        cross = np.exp(-((tries[:, None] - x[None]) ** 2).sum(axis=2) / (2 * width * width))
        mu, v = cross @ a, np.linalg.solve(chol, cross.T)
        s = np.sqrt(np.maximum(1e-12, 1 - (v * v).sum(axis=0)))
        gap = z.min() - mu
        u = gap / s
        cdf = np.array([0.5 * math.erfc(-t / math.sqrt(2)) for t in u])
        gain = gap * cdf + s * np.exp(-u * u / 2) / math.sqrt(2 * math.pi)
        point = tries[int(gain.argmax())]
        x, y = np.vstack([x, point]), np.append(y, evaluate((lo + (hi - lo) * point).tolist()))
    at = int(y.argmin())
    return (lo + (hi - lo) * x[at]).tolist(), float(y[at])


def ternary_search(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-9) -> float:
    """The least point of a function that falls and then rises."""
    while high - low > tolerance * max(1.0, abs(low), abs(high)):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if f(a) <= f(b) else (a, high)
    return (low + high) / 2


def best_first(start: object, around: Callable[[object], Sequence], cost: Callable[[object], float], rounds: int = 1000) -> tuple[object, float]:
    """The cheapest state seen when, each time, the cheapest open one is opened."""
    open_, seen, n = [(cost(start), 0, start)], {start}, 1
    best = (open_[0][0], start)
    for _ in range(rounds):
        if not open_:
            break
        c, _, state = heapq.heappop(open_)
        if c < best[0]:
            best = (c, state)
        for other in around(state):
            if other not in seen:
                seen.add(other)
                heapq.heappush(open_, (cost(other), n, other))
                n += 1
    return best[1], best[0]


def gradient_is_small(gradient: Sequence[float], tolerance: float = 1e-6) -> bool:
    return math.sqrt(sum(g * g for g in gradient)) <= tolerance


def population_has_met(values: Sequence[float], tolerance: float = 1e-8) -> bool:
    """Whether the values of a population lie within `tolerance` of each other, relative to their mean."""
    mean = sum(values) / len(values)
    return max(values) - min(values) <= tolerance * max(1.0, abs(mean))
