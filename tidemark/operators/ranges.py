"""Functions of a series' points in a window, as expressions over ``pts``.

``pts`` is an array of (ts, value) in time order, never empty; ``lo`` and
``hi`` are the window's bounds. A null result drops the series.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.ieee import INF, NAN, fdiv, fgt, flt, fne, lit


def steps(pts: Column, zero: Column, f) -> Column:
    """Folds ``f(acc, previous value, value)`` over adjacent points."""
    start = F.struct(zero.alias("acc"), F.get(pts, F.lit(0))["value"].alias("prev"))
    tail = F.slice(pts, F.lit(2), F.size(pts))
    return F.aggregate(tail, start, lambda s, p: F.struct(f(s["acc"], s["prev"], p["value"]).alias("acc"), p["value"].alias("prev")), lambda s: s["acc"])


def ends(pts: Column) -> tuple[Column, Column]:
    return F.get(pts, F.lit(0)), F.element_at(pts, -1)


def gain(prev: Column, v: Column) -> Column:
    """What a counter gained from ``prev`` to ``v``; a fall is a reset to zero."""
    return F.when((v >= prev) & ~F.isnan(v) & ~F.isnan(prev) | (v == INF), v - prev).otherwise(v)


def increase(pts: Column) -> Column:
    return steps(pts, lit(0), lambda a, prev, v: a + gain(prev, v))


def stretched(first: Column, last: Column, n: Column, raw: Column, lo: Column, hi: Column, units: int, *, counter: bool, rate: bool) -> Column:
    """A difference between two of ``n`` points, stretched to the window's ends; per second for a rate."""
    span = (last["ts"] - first["ts"]).cast("double")
    gap = span / F.when(n > 1, n - 1)
    before, after = (first["ts"] - lo).cast("double"), (hi - last["ts"]).cast("double")
    if counter:
        zero = span * fdiv(first["value"], raw)
        before = F.when(fgt(raw, lit(0)) & (first["value"] >= 0) & flt(zero, before), zero).otherwise(before)
    stretch = span + F.when(before < gap * 1.1, before).otherwise(gap / 2) + F.when(after < gap * 1.1, after).otherwise(gap / 2)
    out = raw * (stretch / F.when(span > 0, span))
    if rate:
        window = (hi - lo).cast("double") / units
        out = out / F.when(window > 0, window)
    return F.when((n > 1) & (span > 0), out)


def extrapolated(pts: Column, lo: Column, hi: Column, units: int, *, counter: bool, rate: bool) -> Column:
    """Delta or counter increase stretched to the window's ends, per second for a rate."""
    first, last = ends(pts)
    raw = increase(pts) if counter else last["value"] - first["value"]
    return stretched(first, last, F.size(pts), raw, lo, hi, units, counter=counter, rate=rate)


def irate(pts: Column, units: int) -> Column:
    a, b = F.get(pts, F.size(pts) - 2), F.element_at(pts, -1)
    dt, dv = (b["ts"] - a["ts"]).cast("double") / units, b["value"] - a["value"]
    return F.when((F.size(pts) > 1) & (dt > 0), F.when(flt(dv, lit(0)), b["value"]).otherwise(dv) / F.when(dt > 0, dt))


def idelta(pts: Column) -> Column:
    return F.when(F.size(pts) > 1, F.element_at(pts, -1)["value"] - F.get(pts, F.size(pts) - 2)["value"])


def changed(prev: Column, v: Column) -> Column:
    return F.when(fne(v, prev), 1.0).otherwise(0.0)


def fell(prev: Column, v: Column) -> Column:
    return F.when(flt(v, prev), 1.0).otherwise(0.0)


def changes(pts: Column) -> Column:
    return steps(pts, lit(0), lambda a, prev, v: a + changed(prev, v))


def resets(pts: Column) -> Column:
    return steps(pts, lit(0), lambda a, prev, v: a + fell(prev, v))


def summary(pts: Column, pair) -> Column:
    """(first, last, n, acc) of a bucket's points; ``acc`` sums ``pair`` over adjacent ones."""
    first, last = ends(pts)
    acc = steps(pts, lit(0), lambda a, prev, v: a + pair(prev, v))
    return F.struct(first.alias("first"), last.alias("last"), F.size(pts).alias("n"), acc.alias("acc"))


def joined(parts: Column, pair) -> Column:
    """The summary of a window from those of its buckets in order."""
    def step(s: Column, p: Column) -> Column:
        acc = s["acc"] + p["acc"] + pair(s["last"]["value"], p["first"]["value"])
        return F.struct(s["first"].alias("first"), p["last"].alias("last"), (s["n"] + p["n"]).alias("n"), acc.alias("acc"))

    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.get(parts, F.lit(0)), step)


def held(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once; else it is again at each mention, and in a lambda for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def quantile(v: Column, phi: Column, nan_first: bool = False) -> Column:
    """Linear interpolation at phi * (n - 1) of the sorted values."""
    rows = F.sort_array(v)
    if nan_first:
        rows = held(rows, lambda s: F.concat(F.filter(s, F.isnan), F.filter(s, lambda x: ~F.isnan(x))))
    return held(rows, lambda s: _at(s, phi))


def _at(s: Column, phi: Column) -> Column:
    at = phi * (F.size(s) - 1)
    low = F.floor(F.when((phi >= 0) & (phi <= 1), at)).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    w = at - low
    inside = F.when(w == 0, a).otherwise(a + (b - a) * w)
    return F.when(F.size(s) == 0, lit(NAN)).when(F.isnan(phi), lit(NAN)).when(phi < 0, lit(-INF)).when(phi > 1, lit(INF)).otherwise(inside)


def mad(v: Column) -> Column:
    return held(quantile(v, lit(0.5)), lambda m: quantile(F.transform(v, lambda x: F.abs(x - m)), lit(0.5)))


def regression(pts: Column, units: int) -> Column:
    """(slope a second, base at the first point) in one fold; null without two times, NaN with a value not finite."""
    t0 = F.get(pts, F.lit(0))["ts"]
    names = ("n", "sx", "sy", "sxy", "sxx")
    zero = F.struct(*[lit(0).alias(k) for k in names], t0.alias("t0"))

    def step(s: Column, p: Column) -> Column:
        x, y = (p["ts"] - s["t0"]).cast("double") / units, p["value"]
        more = (lit(1), x, y, x * y, x * x)
        return F.struct(*[(s[k] + m).alias(k) for k, m in zip(names, more, strict=True)], s["t0"].alias("t0"))

    def finish(s: Column) -> Column:
        den = s["n"] * s["sxx"] - s["sx"] * s["sx"]
        slope = (s["n"] * s["sxy"] - s["sx"] * s["sy"]) / F.when(den != 0, den)
        wild = F.isnan(s["sy"]) | (F.abs(s["sy"]) == INF)
        fit = lambda x: F.when(s["n"] < 2, F.lit(None)).when(wild, lit(NAN)).otherwise(x)
        return F.struct(fit(slope).alias("slope"), fit((s["sy"] - slope * s["sx"]) / s["n"]).alias("base"))

    return F.aggregate(pts, zero, step, finish)


def smoothed(pts: Column, sf: float, tf: float) -> Column:
    """Double exponential smoothing, one step ahead; null with fewer than two points, NaN with a value not finite."""
    v0, v1 = F.get(pts, F.lit(0))["value"], F.get(pts, F.lit(1))["value"]
    start = F.struct(v0.alias("level"), (v1 - v0).alias("trend"))

    def step(s: Column, p: Column) -> Column:
        level = p["value"] * sf + (s["level"] + s["trend"]) * (1 - sf)
        return F.struct(level.alias("level"), ((level - s["level"]) * tf + s["trend"] * (1 - tf)).alias("trend"))

    out = F.aggregate(F.slice(pts, F.lit(2), F.size(pts)), start, step, lambda s: s["level"] + s["trend"])
    wild = F.exists(pts, lambda p: F.isnan(p["value"]) | (F.abs(p["value"]) == INF))
    return F.when(F.size(pts) > 1, F.when(wild, lit(NAN)).otherwise(out))
