"""The shapes that operators have: a transformer, a model, a validator and a scorer; their settings; and tables with named roles."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Named values with checks; a change gives new settings."""

    values: Mapping[str, object]
    checks: Mapping[str, Callable[[object], bool]] = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        wrong = [k for k, ok in self.checks.items() if k not in self.values or not ok(self.values[k])]
        if wrong:
            raise ValueError(f"settings that are missing or wrong: {', '.join(sorted(wrong))}")

    def changed(self, **values: object) -> Settings:
        unknown = set(values) - set(self.values)
        if unknown:
            raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(self, values={**self.values, **values})

    def to_json(self) -> str:
        return json.dumps(dict(self.values), sort_keys=True)


class Transformer:
    """fit makes a state (a small table or numbers) in one pass; transform is lazy."""

    def __init__(self, fit: Callable[[DataFrame], object], transform: Callable[[DataFrame, object], DataFrame], inverse: Callable[[DataFrame, object], DataFrame] | None = None) -> None:
        self._fit, self._transform, self._inverse, self.state = fit, transform, inverse, None

    def fit(self, df: DataFrame) -> Transformer:
        self.state = self._fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.state is None:
            raise RuntimeError("fit comes before transform")
        return self._transform(df, self.state)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        if self._inverse is None:
            raise NotImplementedError("this transformer has no inverse")
        if self.state is None:
            raise RuntimeError("fit comes before inverse_transform")
        return self._inverse(df, self.state)


class Model:
    """fit gives a fitted model with predict(df, name); score aggregates a metric of target and prediction."""

    def __init__(self, fit: Callable[[DataFrame], object], metric: Callable[[Column, Column], Column]) -> None:
        self._fit, self._metric, self.fitted = fit, metric, None

    def fit(self, df: DataFrame) -> Model:
        self.fitted = self._fit(df)
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        if self.fitted is None:
            raise RuntimeError("fit comes before predict")
        return self.fitted.predict(df, name)

    def score(self, df: DataFrame, target: str) -> float:
        return self.predict(df, "__p").agg(self._metric(F.col(target), F.col("__p"))).first()[0]


@dataclass(frozen=True)
class Verdict:
    passed: bool
    errors: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()


@dataclass(frozen=True)
class Check:
    """A condition that every row should meet; up to `allowed` of the rows may fail it, and a mild one only warns."""

    name: str
    condition: Column
    allowed: float = 0.0
    mild: bool = False


def validate(df: DataFrame, checks: Sequence[Check]) -> Verdict:
    """All checks in one pass; a row for which a condition is null fails it."""
    row = df.agg(F.count("*"), *(F.count_if(~F.coalesce(c.condition, F.lit(False))) for c in checks)).first()
    said = [(c, n) for c, n in zip(checks, row[1:], strict=True) if n > c.allowed * row[0]]
    text = lambda c, n: f"{c.name}: {n} of {row[0]} rows"
    errors = tuple(text(c, n) for c, n in said if not c.mild)
    return Verdict(not errors, errors, tuple(text(c, n) for c, n in said if c.mild))


@dataclass(frozen=True)
class TestResult:
    """A hypothesis test's numbers and what they say at a level."""

    statistic: float
    p: float
    level: float = 0.05

    @property
    def rejects(self) -> bool:
        return self.p < self.level

    def to_json(self) -> str:
        return json.dumps({**asdict(self), "rejects": self.rejects}, sort_keys=True)


@dataclass(frozen=True)
class Found:
    """What an optimiser found."""

    point: tuple[float, ...]
    value: float
    rounds: int
    converged: bool


@dataclass(frozen=True)
class Batch:
    """A table whose columns have roles: id, features, label and weight."""

    df: DataFrame
    features: tuple[str, ...]
    label: str | None = None
    id: str | None = None
    weight: str | None = None

    def __post_init__(self) -> None:
        wanted = [*self.features, *(c for c in (self.label, self.id, self.weight) if c)]
        missing = [c for c in wanted if c not in self.df.columns]
        if missing or len(set(wanted)) < len(wanted):
            raise ValueError(f"columns that are missing: {missing}" if missing else "a column has two roles")

    def with_features(self, made: Mapping[str, Column]) -> Batch:
        """More features, or other values of them."""
        return replace(self, df=self.df.withColumns(dict(made)), features=tuple(dict.fromkeys((*self.features, *made))))

    def only(self, names: Sequence[str]) -> Batch:
        """The features named, in this order, beside the other roles."""
        rest = [c for c in (self.id, self.label, self.weight) if c]
        return replace(self, df=self.df.select(*rest, *names), features=tuple(names))

    def where(self, condition: str | Column) -> Batch:
        return replace(self, df=self.df.where(condition))
