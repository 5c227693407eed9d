"""Scorers by name: functions of (prompt, completion, answer, type) columns that give a column in [0, 1]."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

Scorer = Callable[[Column, Column, Column, Column], Column]


@dataclass
class Entry:
    scorer: Scorer
    default: bool = False
    level: str = ""
    tags: tuple[str, ...] = field(default=())


REGISTRY: dict[str, Entry] = {}


def sanitized(x: Column) -> Column:
    """Nulls and non-finite scores are 0; others are cut to [0, 1]."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def register(name: str, default: bool = False, level: str = "", tags: tuple[str, ...] = ()):
    """A decorator; a name that is taken warns and is replaced."""

    def wrap(scorer: Scorer) -> Scorer:
        if name in REGISTRY:
            warnings.warn(f"scorer {name} is replaced", stacklevel=2)
        REGISTRY[name] = Entry(scorer, default, level, tags)
        return scorer

    return wrap


def get(name: str) -> Scorer:
    if name not in REGISTRY:
        raise KeyError(f"no scorer {name}; there are {', '.join(names())}")
    return REGISTRY[name].scorer


def names(level: str | None = None, tag: str | None = None) -> list[str]:
    return sorted(n for n, e in REGISTRY.items() if (level is None or e.level == level) and (tag is None or tag in e.tags))


def defaults() -> list[str]:
    return sorted(n for n, e in REGISTRY.items() if e.default)


def score(df: DataFrame, wanted: list[str], prompt: str = "prompt", completion: str = "completion", answer: str = "answer", kind: str = "type") -> DataFrame:
    """df with a column for each scorer, all in one pass."""
    args = [F.col(c) for c in (prompt, completion, answer, kind)]
    return df.withColumns({n: sanitized(get(n)(*args)) for n in wanted})
