"""Float semantics of the query language as Column expressions.

Spark's ANSI mode raises where IEEE gives infinities, and its comparisons rank
NaN; every arithmetic the engine emits goes through these wrappers.
"""

from __future__ import annotations

import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def lit(x: float) -> Column:
    return F.lit(float(x))


def negative(x: Column) -> Column:
    """True below zero and for -0.0."""
    return (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))


def fdiv(a: Column, b: Column) -> Column:
    signed = F.when(negative(a) == negative(b), lit(INF)).otherwise(lit(-INF))
    zero = F.when((a == 0) | F.isnan(a), lit(NAN)).otherwise(signed)
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def fmod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; NaN for a zero divisor or an infinite dividend."""
    bad = (b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == INF)
    return F.when(bad, lit(NAN)).when(F.abs(b) == INF, a).otherwise(a % F.when(b != 0, b))


def _ordered(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b)


def feq(a: Column, b: Column) -> Column:
    return (a == b) & _ordered(a, b)


def fne(a: Column, b: Column) -> Column:
    return ~feq(a, b)


def flt(a: Column, b: Column) -> Column:
    return (a < b) & _ordered(a, b)


def fle(a: Column, b: Column) -> Column:
    return (a <= b) & _ordered(a, b)


def fgt(a: Column, b: Column) -> Column:
    return (a > b) & _ordered(a, b)


def fge(a: Column, b: Column) -> Column:
    return (a >= b) & _ordered(a, b)


def _whole(x: Column, f) -> Column:
    """``f`` (to BIGINT in Spark) where a fraction is possible, else x."""
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(f(x).cast("double"))


def ffloor(x: Column) -> Column:
    return _whole(x, F.floor)


def fceil(x: Column) -> Column:
    return _whole(x, F.ceil)


def ftrunc(x: Column) -> Column:
    return F.when(negative(x), fceil(x)).otherwise(ffloor(x))


def away(x: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    up = ffloor(F.abs(x))
    near = F.when(F.abs(x) - up >= 0.5, up + 1.0).otherwise(up)
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).when(negative(x), -near).otherwise(near)


def fround(x: Column, n: float) -> Column:
    if n == 0 or not math.isfinite(n):
        return F.when(x.isNotNull(), lit(NAN))
    return away(fdiv(x, lit(n))) * n


def logarithm(x: Column, f) -> Column:
    return F.when(F.isnan(x) | (x < 0), lit(NAN)).when(x == 0, lit(-INF)).when(x == INF, lit(INF)).otherwise(f(F.when(x > 0, x)))


def sgn(x: Column) -> Column:
    """NaN for NaN, else 1 or -1 by the sign bit."""
    return F.when(F.isnan(x), lit(NAN)).when(negative(x), lit(-1.0)).otherwise(lit(1.0))


def fpow(a: Column, b: Column) -> Column:
    return F.when((a == 1) | (b == 0), lit(1.0)).otherwise(F.pow(a, b))


def format_number(x: float | None) -> str | None:
    """Shortest text without an exponent: 450, 0.5, NaN, +Inf, -Inf."""
    if x is None:
        return None
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    text = format(Decimal(repr(x)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def number_text():
    """``format_number`` as a vectorized UDF."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(format_number)

    return text
