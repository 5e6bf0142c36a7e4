"""Control plane: steps and pipelines, artefacts, lineage, tuning, early stopping and bandits. Small objects on the driver; data stay in DataFrames."""

from __future__ import annotations

import itertools
import json
import math
import random
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.relational import pseudo_random


@dataclass
class Step:
    """fit(df) gives a fitted object with transform(df), or None when transform needs no fit."""

    name: str
    fit: Callable[[DataFrame], object] | None = None
    transform: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Pipeline:
    steps: Sequence[Step]
    fitted: dict[str, object] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Pipeline:
        for step in self.steps:
            if step.fit:
                self.fitted[step.name] = step.fit(df)
            df = self._apply(step, df)
        return self

    def _apply(self, step: Step, df: DataFrame) -> DataFrame:
        return self.fitted[step.name].transform(df) if step.fit else step.transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = self._apply(step, df)
        return df


@dataclass
class Artifact:
    """What is known of a fitted model, without the model."""

    name: str
    version: str = "1"
    parameters: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    tags: list = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Artifact:
        return Artifact(**json.loads(text))


LINEAGE = "event string, id string, kind string, inputs array<string>, detail string, at double"


class Lineage:
    """An append-only table of sources and transformations."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def record(self, kind: str, inputs: Sequence[str] = (), **detail) -> str:
        if kind not in ("source", "transformation"):
            raise ValueError("kind must be 'source' or 'transformation'")
        made = uuid.uuid4().hex
        self.spark.createDataFrame([(uuid.uuid4().hex, made, kind, list(inputs), json.dumps(detail, sort_keys=True), time.time())], LINEAGE).coalesce(1).write.mode("append").parquet(self.path)
        return made

    def events(self) -> DataFrame:
        return self.spark.read.schema(LINEAGE).parquet(self.path)

    def ancestors(self, of: str) -> list[str]:
        """All that an output rests on, nearest first: generation by generation, so that of the log only an output's own history is read out."""
        events, found, todo = self.events().select("id", "inputs"), [], [of]
        while todo:
            inputs = {r["id"]: r["inputs"] for r in events.where(F.col("id").isin(todo)).collect()}
            todo = list(dict.fromkeys(i for t in todo for i in inputs.get(t, ()) if i not in found))
            found += todo
        return found


def grid(space: Mapping[str, Sequence]) -> Iterator[dict]:
    for values in itertools.product(*space.values()):
        yield dict(zip(space, values, strict=True))


def random_points(space: Mapping[str, Sequence], n: int, seed: int = 0) -> Iterator[dict]:
    rng = random.Random(seed)
    for _ in range(n):
        yield {k: rng.choice(list(v)) for k, v in space.items()}


def cross_validated(df: DataFrame, id_col: str, k: int, fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], float], seed: int = 0) -> list[float]:
    """A score for each fold; a row's fold is that of its id's hash."""
    rows = df.withColumn("__fold", pseudo_random(id_col, seed) % k)
    return [score(fit(rows.where(F.col("__fold") != i).drop("__fold")), rows.where(F.col("__fold") == i).drop("__fold")) for i in range(k)]


def tuned(points: Iterator[dict], evaluate: Callable[[dict], float], minimise: bool = True) -> tuple[dict, float, list[tuple[dict, float]]]:
    """The best point, its value and the history."""
    history = [(p, evaluate(p)) for p in points]
    best = (min if minimise else max)(history, key=lambda x: x[1])
    return *best, history


@dataclass
class EarlyStop:
    """stop(value) says when `patience` values in a row have not improved on the best by `least`."""

    patience: int = 3
    least: float = 0.0
    minimise: bool = True
    best: float | None = None
    waited: int = 0

    def stop(self, value: float) -> bool:
        gain = math.inf if self.best is None else (self.best - value if self.minimise else value - self.best)
        if gain > self.least:
            self.best, self.waited = value, 0
        else:
            self.waited += 1
        return self.waited >= self.patience


class EpsilonGreedy:
    """Arms by mean reward; now and then any arm."""

    def __init__(self, arms: int, epsilon: float = 0.1, seed: int = 0) -> None:
        self.counts, self.totals, self.epsilon, self.rng = [0] * arms, [0.0] * arms, epsilon, random.Random(seed)

    def choose(self) -> int:
        untried = [i for i, c in enumerate(self.counts) if not c]
        if untried:
            return untried[0]
        if self.rng.random() < self.epsilon:
            return self.rng.randrange(len(self.counts))
        return max(range(len(self.counts)), key=lambda i: (self.totals[i] / self.counts[i], -i))

    def update(self, arm: int, reward: float) -> None:
        self.counts[arm] += 1
        self.totals[arm] += reward

    def update_from(self, log: DataFrame, arm: str = "arm", reward: str = "reward") -> None:
        """Rewards of a whole log, as one aggregate."""
        for r in log.groupBy(arm).agg(F.count("*").alias("n"), F.sum(reward).alias("s")).collect():
            self.counts[r[arm]] += r["n"]
            self.totals[r[arm]] += r["s"]


class Thompson:
    """Beta posteriors of 0/1 rewards."""

    def __init__(self, arms: int, seed: int = 0) -> None:
        self.wins, self.losses, self.rng = [1.0] * arms, [1.0] * arms, random.Random(seed)

    def choose(self) -> int:
        return max(range(len(self.wins)), key=lambda i: self.rng.betavariate(self.wins[i], self.losses[i]))

    def update(self, arm: int, reward: int) -> None:
        (self.wins if reward else self.losses)[arm] += 1


class AdaptiveWindow:
    """Drift of a stream's mean: the window is cut where two parts differ by more than Hoeffding's bound. Buckets double in size, so
    a window of n values takes about `per_size` * log2(n) numbers."""

    def __init__(self, delta: float = 0.002, per_size: int = 5) -> None:
        self.delta, self.per_size = delta, per_size
        self.rows: list[list[tuple[float, float]]] = [[]]  # of each size: (total, sum of squares), newest first

    def add(self, x: float) -> bool:
        """Whether the window was cut."""
        self.rows[0].insert(0, (x, x * x))
        for i in itertools.count():
            if i >= len(self.rows) or len(self.rows[i]) <= self.per_size:
                break
            if i + 1 == len(self.rows):
                self.rows.append([])
            (a, b), (c, d) = self.rows[i].pop(), self.rows[i].pop()
            self.rows[i + 1].insert(0, (a + c, b + d))
        return self._cut()

    def _cut(self) -> bool:
        cut = False
        while True:
            parts = [(1 << i, t, q) for i in range(len(self.rows) - 1, -1, -1) for t, q in reversed(self.rows[i])]
            n, total, squares = (sum(p[j] for p in parts) for j in range(3))
            if n < 10:
                return cut
            var = max(squares / n - (total / n) ** 2, 0.0)
            n0 = t0 = 0.0
            found = False
            for size, t, _ in parts[:-1]:
                n0, t0 = n0 + size, t0 + t
                n1 = n - n0
                if n0 < 5 or n1 < 5:
                    continue
                m = 1 / (1 / n0 + 1 / n1)
                d = math.log(2 * math.log(max(n, 3)) / self.delta)
                if abs(t0 / n0 - (total - t0) / n1) > math.sqrt(2 / m * var * d) + 2 / (3 * m) * d:
                    found = True
                    break
            if not found:
                return cut
            for i in range(len(self.rows) - 1, -1, -1):
                if self.rows[i]:
                    self.rows[i].pop()
                    break
            cut = True

    @property
    def size(self) -> int:
        return sum(len(r) << i for i, r in enumerate(self.rows))


def drift_points(df: DataFrame, key: str, order: Sequence[str], value: str, delta: float = 0.002) -> DataFrame:
    """(key, place): where an adaptive window over each key's ordered values was cut."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        window = AdaptiveWindow(delta)
        at = [i for i, x in enumerate(part.sort_values(list(order))[value].to_numpy(float)) if window.add(float(x))]
        return pd.DataFrame({key: [part[key].iloc[0]] * len(at), "place": at})

    return df.select(key, *order, value).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, place long")


class LinearThompson:
    """An arm's reward is linear in a context, with a normal posterior of its weights; the arm whose drawn reward is largest is played."""

    def __init__(self, arms: int, size: int, noise: float = 1.0, seed: int = 0) -> None:
        import numpy as np

        self.rng, self.noise = np.random.default_rng(seed), noise
        self.precision = [np.eye(size) for _ in range(arms)]
        self.pull = [np.zeros(size) for _ in range(arms)]

    def choose(self, context: Sequence[float]) -> int:
        import numpy as np

        x, drawn = np.asarray(context, float), []
        for a, b in zip(self.precision, self.pull, strict=True):
            cov = np.linalg.inv(a)
            drawn.append(float(x @ self.rng.multivariate_normal(cov @ b, self.noise**2 * cov)))
        return int(np.argmax(drawn))

    def update(self, arm: int, context: Sequence[float], reward: float) -> None:
        import numpy as np

        x = np.asarray(context, float)
        self.precision[arm] = self.precision[arm] + np.outer(x, x)
        self.pull[arm] = self.pull[arm] + reward * x

    def update_from(self, log: DataFrame, arm: str, context: Sequence[str], reward: str) -> None:
        """A whole log at once: sums of products by arm, from one pass."""
        pairs = [(i, j) for i in range(len(context)) for j in range(i, len(context))]
        for r in log.groupBy(arm).agg(*(F.sum(F.col(context[i]) * F.col(context[j])) for i, j in pairs), *(F.sum(F.col(c) * F.col(reward)) for c in context)).collect():
            for (i, j), v in zip(pairs, r[1:], strict=False):
                self.precision[r[0]][i, j] += v
                self.precision[r[0]][j, i] += v if i != j else 0.0
            self.pull[r[0]] = self.pull[r[0]] + [float(v) for v in r[1 + len(pairs) :]]


def robustness(df: DataFrame, id_col: str, columns: Sequence[str], score: Callable[[DataFrame], float], sizes: Sequence[float] = (0.01, 0.05, 0.1), seed: int = 0) -> list[tuple[float, float]]:
    """(size, score) of rows whose columns are moved by up to size deviations either way; size 0 first."""
    from quarry.operators.sampling import unit

    spread = df.agg(*(F.stddev_pop(c) for c in columns)).first()
    out = [(0.0, score(df))]
    for s in sizes:
        out.append((s, score(df.withColumns({c: F.col(c) + (unit(id_col, seed + i) * 2 - 1) * s * float(d or 0) for i, (c, d) in enumerate(zip(columns, spread, strict=True))}))))
    return out
