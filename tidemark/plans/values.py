"""What an expression evaluates to."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Grid:
    """Evaluation times start, start + step, ...: ``n`` of them, in whole units."""

    start: int
    step: int
    n: int

    @property
    def last(self) -> int:
        return self.start + self.step * (self.n - 1)


@dataclass
class Scalar:
    """``const``, or a frame of (step_ts, value) with a row for every step."""

    const: float | None = None
    df: DataFrame | None = None


@dataclass
class Vector:
    """Rows (step_ts, metric, labels, ts, value[, hist]): at most one a step and identity."""

    df: DataFrame


@dataclass
class Range:
    """Rows (step_ts, metric, labels, p_ts, seq, value[, hist]), one a point; window bounds by step."""

    df: DataFrame
    lo: Any
    hi: Any

    def bounds(self, step: Column) -> tuple[Column, Column]:
        return self.lo(step), self.hi(step)


@dataclass
class Buckets:
    """Rows (metric, labels, _b, p_ts, seq, value) of a range vector, each once; ``spread`` repeats rows by ``_b`` on the steps they serve."""

    df: DataFrame
    spread: Any
    lo: Any
    hi: Any


@dataclass
class Text:
    value: str
