"""The functions of the query language."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentCount, EvalError, TypeMismatch, UnknownFunction
from ..functions import ieee as I
from ..functions.hashes import natural
from ..functions.patterns import replacer
from ..model import LABELS, drop_labels, has_label, label, set_label
from ..operators import histogram as H
from ..operators import ranges as R
from . import ast
from .values import Buckets, Grid, Range, Scalar, Text, Vector

ID = ["step_ts", "metric", "labels"]

ELEMENTWISE: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "ceil": I.fceil,
    "floor": I.ffloor,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "ln": lambda x: I.logarithm(x, F.ln),
    "log2": lambda x: I.logarithm(x, F.log2),
    "log10": lambda x: I.logarithm(x, F.log10),
    "sgn": I.sgn,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "asinh": F.asinh,
    "acosh": F.acosh,
    "atanh": F.atanh,
    "deg": F.degrees,
    "rad": F.radians,
}


def _date(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def run(x: Column) -> Column:
        ok = ~F.isnan(x) & (F.abs(x) < 9e11)
        return F.when(ok, f(F.timestamp_seconds(F.when(ok, I.ftrunc(x)).cast("bigint"))).cast("double")).otherwise(I.lit(I.NAN))

    return run


CALENDAR = {
    "minute": _date(F.minute),
    "hour": _date(F.hour),
    "day_of_week": _date(lambda t: F.dayofweek(t) - 1),
    "day_of_month": _date(F.dayofmonth),
    "day_of_year": _date(F.dayofyear),
    "days_in_month": _date(lambda t: F.dayofmonth(F.last_day(t))),
    "month": _date(F.month),
    "year": _date(F.year),
}

#: Range functions that need a window's points in order: (pts, lo, hi, units) to a value.
ORDERED: dict[str, Callable[[Column, Column, Column, int], Column]] = {
    "rate": lambda p, lo, hi, u: R.extrapolated(p, lo, hi, u, counter=True, rate=True),
    "increase": lambda p, lo, hi, u: R.extrapolated(p, lo, hi, u, counter=True, rate=False),
    "delta": lambda p, lo, hi, u: R.extrapolated(p, lo, hi, u, counter=False, rate=False),
    "irate": lambda p, lo, hi, u: R.irate(p, u),
    "idelta": lambda p, lo, hi, u: R.idelta(p),
    "changes": lambda p, lo, hi, u: R.changes(p),
    "resets": lambda p, lo, hi, u: R.resets(p),
    "deriv": lambda p, lo, hi, u: R.regression(p, u)["slope"],
}


def _real() -> Column:
    return F.when(~F.isnan("value"), F.col("value"))


def _variance() -> Column:
    """Population variance. Large values are scaled, for merging squares the difference of two means."""
    x, by = F.col("value"), I.lit(2.0**520)
    return F.when(F.max(F.abs(x)) < 1e140, F.var_pop(x)).otherwise(F.var_pop(x / by) * by * by)


#: Range functions that combine on the map side.
COMBINING: dict[str, Callable[[], Column]] = {
    "avg_over_time": lambda: F.avg("value"),
    "sum_over_time": lambda: F.sum("value"),
    "min_over_time": lambda: F.coalesce(F.min(_real()), I.lit(I.INF)),
    "max_over_time": lambda: F.coalesce(F.max(_real()), I.lit(-I.INF)),
    "count_over_time": lambda: F.count(F.lit(1)).cast("double"),
    "present_over_time": lambda: F.max(I.lit(1)),
    "last_over_time": lambda: F.max_by("value", F.struct("p_ts", "seq")),
    "stddev_over_time": lambda: F.sqrt(_variance()),
    "stdvar_over_time": _variance,
}


#: Most of them in two stages: columns of a bucket, and a window's value from those of its buckets.
STAGED: dict[str, tuple[Callable[[], dict[str, Column]], Callable[[], Column]]] = {
    "avg_over_time": (lambda: {"s": F.sum("value"), "n": F.count(F.lit(1))}, lambda: F.sum("s") / F.sum("n")),
    "sum_over_time": (lambda: {"s": F.sum("value")}, lambda: F.sum("s")),
    "min_over_time": (lambda: {"s": F.min(_real())}, lambda: F.coalesce(F.min("s"), I.lit(I.INF))),
    "max_over_time": (lambda: {"s": F.max(_real())}, lambda: F.coalesce(F.max("s"), I.lit(-I.INF))),
    "count_over_time": (lambda: {"n": F.count(F.lit(1))}, lambda: F.sum("n").cast("double")),
    "present_over_time": (lambda: {"n": F.max(I.lit(1))}, lambda: F.max("n")),
    "last_over_time": (lambda: {"s": F.max_by("value", F.struct("p_ts", "seq"))}, lambda: F.max_by("s", "_b")),
}

#: Ordered functions that add up over adjacent points: what a pair adds, and a window's value from its summary.
ADDING: dict[str, tuple[Callable, Callable[[Column, Column, Column, int], Column]]] = {
    "rate": (R.gain, lambda w, lo, hi, u: R.stretched(w["first"], w["last"], w["n"], w["acc"], lo, hi, u, counter=True, rate=True)),
    "increase": (R.gain, lambda w, lo, hi, u: R.stretched(w["first"], w["last"], w["n"], w["acc"], lo, hi, u, counter=True, rate=False)),
    "delta": (lambda prev, v: v - prev, lambda w, lo, hi, u: R.stretched(w["first"], w["last"], w["n"], w["last"]["value"] - w["first"]["value"], lo, hi, u, counter=False, rate=False)),
    "changes": (R.changed, lambda w, lo, hi, u: w["acc"]),
    "resets": (R.fell, lambda w, lo, hi, u: w["acc"]),
}


class _Call:
    def __init__(self, run, e: ast.Call, grid: Grid):
        self.run, self.e, self.grid = run, e, grid
        self.name = e.name.lower()

    def count(self, least: int, most: int | None = None) -> None:
        most = least if most is None else most
        if not least <= len(self.e.args) <= most:
            raise ArgumentCount(f"{self.name} takes {least if least == most else f'{least} to {most}'} argument(s), not {len(self.e.args)}")

    def value(self, i: int):
        return self.run.eval(self.e.args[i], self.grid)

    def vector(self, i: int) -> Vector:
        v = self.value(i)
        if not isinstance(v, Vector):
            raise TypeMismatch(f"{self.name} needs an instant vector")
        return v

    def ranged(self, i: int) -> Range:
        v = self.value(i)
        if not isinstance(v, Range):
            raise TypeMismatch(f"{self.name} needs a range vector")
        return v

    def text(self, i: int) -> str:
        v = self.value(i)
        if not isinstance(v, Text):
            raise TypeMismatch(f"{self.name} needs a string")
        return v.value

    def number(self, i: int, df: DataFrame) -> tuple[DataFrame, Column]:
        s = self.value(i)
        if not isinstance(s, Scalar):
            raise TypeMismatch(f"{self.name} needs a scalar")
        if s.const is not None:
            return df, I.lit(s.const)
        name = f"_p{i}"
        return df.join(s.df.withColumnRenamed("value", name), "step_ts"), F.col(name)

    def constant(self, i: int) -> float:
        s = self.value(i)
        if isinstance(s, Scalar) and s.const is None:
            rows = s.df.select("value").distinct().limit(2).collect()
            if len(rows) == 1:
                return rows[0][0]
        if not isinstance(s, Scalar) or s.const is None:
            raise TypeMismatch(f"{self.name} needs a constant scalar")
        return s.const

    def elementwise(self, f: Callable[[Column], Column], i: int = 0):
        v = self.value(i)
        if isinstance(v, Scalar):
            return Scalar(df=self.run.scalar_frame(v, self.grid).withColumn("value", f(F.col("value"))))
        if not isinstance(v, Vector):
            raise TypeMismatch(f"{self.name} needs a scalar or an instant vector")
        return Vector(self.run.no_hist(v.df, self.name).withColumn("value", f(F.col("value"))))

    def out(self, df: DataFrame) -> Vector:
        """A vector stamped with the evaluation time."""
        if self.run.hist and "hist" not in df.columns:
            df = df.withColumn("hist", F.lit(None).cast(self.run.engine.samples.schema["hist"].dataType))
        return Vector(df.select(*ID, F.col("step_ts").alias("ts"), *self.run.payload))

    def points(self, r: Range) -> DataFrame:
        """One row a series and step with its sorted points."""
        df = self.run.no_hist(r.df, self.name)
        raw = F.array_sort(F.collect_list(F.struct(F.col("p_ts").alias("ts"), "seq", "value")))
        return df.groupBy(*ID).agg(raw.alias("raw")).select(*ID, F.transform("raw", lambda p: F.struct(p["ts"].alias("ts"), p["value"].alias("value"))).alias("pts"))

    def values(self, r: Range) -> DataFrame:
        """One row a series and step with its values in no order, as ``v``."""
        return self.run.no_hist(r.df, self.name).groupBy(*ID).agg(F.collect_list("value").alias("v"))

    def staged(self, b: Buckets) -> Vector:
        """A combining function over overlapping windows: samples to buckets, buckets to steps."""
        parts, value = STAGED[self.name]
        df = b.spread(b.df.groupBy("metric", "labels", "_b").agg(*[c.alias(k) for k, c in parts().items()]))
        return self.out(df.groupBy(*ID).agg(value().alias("value")))

    def adding(self, b: Buckets) -> Vector:
        """An adding function over overlapping windows: only a bucket's points, and a window's buckets, are put in order."""
        pair, value = ADDING[self.name]
        raw = F.array_sort(F.collect_list(F.struct(F.col("p_ts").alias("ts"), "seq", "value")))
        points = F.transform("raw", lambda p: F.struct(p["ts"].alias("ts"), p["value"].alias("value")))
        df = b.df.groupBy("metric", "labels", "_b").agg(raw.alias("raw")).select("metric", "labels", "_b", points.alias("pts"))
        df = b.spread(df.select("metric", "labels", "_b", R.summary(F.col("pts"), pair).alias("part")))
        df = df.groupBy(*ID).agg(F.array_sort(F.collect_list(F.struct("_b", "part"))).alias("parts"))
        df = df.select(*ID, R.joined(F.transform("parts", lambda p: p["part"]), pair).alias("w"))
        out = value(F.col("w"), b.lo(F.col("step_ts")), b.hi(F.col("step_ts")), self.run.units).cast("double")
        return self.out(df.withColumn("value", out).where(F.col("value").isNotNull()))

    def ordered(self, f, i: int = 0) -> Vector:
        if self.name in ADDING and (b := self.run.bucketed(self.e.args[i], self.grid)) is not None:
            return self.adding(b)
        r = self.ranged(i)
        lo, hi = r.bounds(F.col("step_ts"))
        if self.run.hist and self.name in ("rate", "increase"):
            return self.histograms(r, f, lo, hi)
        df = self.points(r)
        return self.out(df.withColumn("value", f(F.col("pts"), lo, hi, self.run.units).cast("double")).where(F.col("value").isNotNull()))

    def histograms(self, r: Range, f, lo: Column, hi: Column) -> Vector:
        kind = F.count("hist")
        g = self.run.guard
        g(r.df.groupBy(*ID).agg(kind.alias("h"), F.count(F.lit(1)).alias("n")).where("h > 0 and h < n"), f"{self.name} of floats and histograms in one series")
        g(r.df.where("hist.reset_hint = 'Gauge'"), f"{self.name} of gauge histograms")
        raw = F.array_sort(F.collect_list(F.struct(F.col("p_ts").alias("ts"), "seq", "value", "hist"))).alias("pts")
        # seq is unique within a time, so sorting never compares histograms
        df = r.df.groupBy(*ID).agg(raw)
        floats = F.get("pts", F.lit(0))["hist"].isNull()
        first, last = R.ends(F.col("pts"))
        span = (last["ts"] - first["ts"]).cast("double")
        gap = span / F.when(F.size("pts") > 1, F.size("pts") - 1)
        before, after = (first["ts"] - lo).cast("double"), (hi - last["ts"]).cast("double")
        stretch = span + F.when(before < gap * 1.1, before).otherwise(gap / 2) + F.when(after < gap * 1.1, after).otherwise(gap / 2)
        by = stretch / F.when(span > 0, span)
        if self.name == "rate":
            by = by / ((hi - lo).cast("double") / self.run.units)
        whole = H.scale(H.increase(F.transform("pts", lambda p: F.struct(p["ts"].alias("ts"), p["hist"].alias("hist")))), by)
        kind_of = self.run.engine.samples.schema["hist"].dataType
        df = df.withColumn("value", F.when(floats, f(F.col("pts"), lo, hi, self.run.units)))
        df = df.withColumn("hist", F.when(~floats & (F.size("pts") > 1) & (span > 0), whole).cast(kind_of))
        return self.out(df.where("value is not null or hist is not null"))


def evaluate(run, e: ast.Call, grid: Grid):
    c = _Call(run, e, grid)
    n = c.name
    if n in ELEMENTWISE:
        c.count(1)
        return c.elementwise(ELEMENTWISE[n])
    if n in CALENDAR:
        c.count(0, 1)
        if e.args:
            return c.elementwise(CALENDAR[n])
        now = run.steps(grid).withColumn("value", CALENDAR[n](F.col("step_ts") / run.units))
        return _stamped(c, now)
    if n in COMBINING:
        c.count(1)
        if n in STAGED and (b := run.bucketed(e.args[0], grid)) is not None:
            return c.staged(b)
        r = c.ranged(0)
        return c.out(run.no_hist(r.df, n).groupBy(*ID).agg(COMBINING[n]().alias("value")))
    if n in ORDERED:
        c.count(1)
        return c.ordered(ORDERED[n])
    f = OTHERS.get(n)
    if f is None:
        raise UnknownFunction(e.name)
    return f(c)


def _stamped(c: _Call, df: DataFrame) -> Vector:
    """An unlabeled vector from (step_ts, value)."""
    return c.out(df.withColumns({"metric": F.lit(""), "labels": F.array().cast(LABELS)}))


def _quantile_over_time(c: _Call):
    c.count(2)
    df, phi = c.number(0, c.values(c.ranged(1)))
    return c.out(df.withColumn("value", R.quantile(F.col("v"), phi)))


def _mad_over_time(c: _Call):
    c.count(1)
    return c.out(c.values(c.ranged(0)).withColumn("value", R.mad(F.col("v"))))


def _predict_linear(c: _Call):
    c.count(2)
    df, ahead = c.number(1, c.points(c.ranged(0)))
    df = df.withColumn("fit", R.regression(F.col("pts"), c.run.units))
    x = (F.col("step_ts") - F.get("pts", F.lit(0))["ts"]).cast("double") / c.run.units + ahead
    return c.out(df.withColumn("value", F.col("fit.slope") * x + F.col("fit.base")).where(F.col("value").isNotNull()))


def _smoothing(c: _Call):
    c.count(3)
    sf, tf = c.constant(1), c.constant(2)
    for x in (sf, tf):
        if not 0 <= x <= 1:
            raise EvalError(f"{c.name} needs factors in [0, 1]")
    return c.ordered(lambda p, lo, hi, u: R.smoothed(p, sf, tf))


def _round(c: _Call):
    c.count(1, 2)
    to = c.constant(1) if len(c.e.args) == 2 else 1.0
    return c.elementwise(lambda x: I.fround(x, to))


def _clamp(c: _Call):
    c.count(3)
    lo, hi = c.constant(1), c.constant(2)
    if lo > hi:
        v = c.value(0)
        return Scalar(const=math.nan) if isinstance(v, Scalar) else Vector(v.df.where("false"))
    if math.isnan(lo) or math.isnan(hi):
        return c.elementwise(lambda x: F.when(x.isNotNull(), I.lit(I.NAN)))
    return c.elementwise(lambda x: F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, I.lit(lo)), I.lit(hi))))


def _clamp_one(c: _Call):
    c.count(2)
    bound = c.constant(1)
    pick = F.greatest if c.name == "clamp_min" else F.least
    if math.isnan(bound):
        return c.elementwise(lambda x: x)
    return c.elementwise(lambda x: F.when(F.isnan(x), I.lit(bound)).otherwise(pick(x, I.lit(bound))))


def _pi(c: _Call):
    c.count(0)
    return Scalar(const=math.pi)


def _time(c: _Call):
    c.count(0)
    return Scalar(df=c.run.steps(c.grid).withColumn("value", F.col("step_ts") / c.run.units))


def _timestamp(c: _Call):
    c.count(1)
    v = c.vector(0)
    df = v.df.withColumn("value", F.col("ts") / c.run.units)
    if c.run.hist:
        df = df.withColumn("hist", F.lit(None).cast(df.schema["hist"].dataType))
    return Vector(df)


def _scalar(c: _Call):
    c.count(1)
    df = c.vector(0).df
    n = df.groupBy("step_ts").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("v"), *([F.count("hist").alias("h")] if c.run.hist else []))
    if c.run.hist:
        c.run.guard(n.where("n = 1 and h = 1"), "scalar of a histogram")
    out = c.run.steps(c.grid).join(n, "step_ts", "left").select("step_ts", F.when(F.col("n") == 1, F.col("v")).otherwise(I.lit(I.NAN)).alias("value"))
    return Scalar(df=out)


def _count_scalar(c: _Call):
    c.count(1)
    n = c.vector(0).df.groupBy("step_ts").count()
    return Scalar(df=c.run.steps(c.grid).join(n, "step_ts", "left").select("step_ts", F.coalesce(F.col("count"), F.lit(0)).cast("double").alias("value")))


def _vector(c: _Call):
    c.count(1)
    s = c.value(0)
    if not isinstance(s, Scalar):
        raise TypeMismatch("vector needs a scalar")
    return _stamped(c, c.run.scalar_frame(s, c.grid))


def _sort(c: _Call):
    c.count(1)
    x = F.col("value")
    return Vector(c.vector(0).df.orderBy("step_ts", F.isnan(x), x.asc() if c.name == "sort" else x.desc(), "metric", "labels"))


def _sort_by_label(c: _Call):
    if len(c.e.args) < 2:
        raise ArgumentCount(f"{c.name} needs a vector and at least one label")
    names = [c.text(i) for i in range(1, len(c.e.args))]
    keys = [natural()(label(F.col("labels"), x)) for x in names] + [F.col("metric"), F.col("labels")]
    return Vector(c.vector(0).df.orderBy("step_ts", *[k.desc() if c.name.endswith("desc") else k.asc() for k in keys]))


def _absent(c: _Call):
    """One row of the equality matchers' labels on each step without a result."""
    c.count(1)
    v = c.ranged(0) if c.name == "absent_over_time" else c.vector(0)
    arg = c.e.args[0]
    pairs: dict[str, list[str]] = {}
    if isinstance(arg, ast.Selector):
        for m in arg.matchers:
            if m.op == "=" and m.name != "__name__":
                pairs.setdefault(m.name, []).append(m.value)
    labels = F.array().cast(LABELS)
    for name, vals in pairs.items():
        if len(vals) == 1:
            labels = set_label(labels, name, F.lit(vals[0]))
    missing = c.run.steps(c.grid).join(v.df.select("step_ts").distinct(), "step_ts", "left_anti")
    return c.out(missing.withColumns({"metric": F.lit(""), "labels": labels, "value": I.lit(1)}))


def _drop_common(c: _Call):
    c.count(1)
    df = c.vector(0).df
    n = df.groupBy("step_ts").agg(F.count(F.lit(1)).alias("n"))
    pairs = df.select("step_ts", F.explode("labels").alias("l")).groupBy("step_ts", "l").agg(F.count(F.lit(1)).alias("k"))
    common = pairs.join(n, "step_ts").where("k = n").groupBy("step_ts").agg(F.collect_list("l").alias("_c"))
    out = df.join(common, "step_ts", "left")
    return Vector(out.withColumn("labels", F.when(F.col("_c").isNull(), F.col("labels")).otherwise(F.array_except("labels", "_c"))).drop("_c"))


def _label_replace(c: _Call):
    c.count(5)
    dst, template, src, pattern = (c.text(i) for i in range(1, 5))
    df = c.vector(0).df
    new = replacer(pattern, template)(label(F.col("labels"), src))
    df = df.withColumn("_n", new)
    return Vector(df.withColumn("labels", F.when(F.col("_n").isNull(), F.col("labels")).otherwise(set_label(F.col("labels"), dst, F.col("_n")))).drop("_n"))


def _label_join(c: _Call):
    if len(c.e.args) < 4:
        raise ArgumentCount("label_join needs a vector, a label, a separator and source labels")
    dst, sep = c.text(1), c.text(2)
    parts = [label(F.col("labels"), c.text(i)) for i in range(3, len(c.e.args))]
    return Vector(c.vector(0).df.withColumn("labels", set_label(F.col("labels"), dst, F.concat_ws(sep, *parts))))


def _info(c: _Call):
    """Adds the labels of info series with the same job and instance, read at the evaluation time."""
    c.count(1, 2)
    matchers: tuple[ast.Matcher, ...] = (ast.Matcher("__name__", "=", "target_info"),)
    if len(c.e.args) == 2:
        arg = c.e.args[1]
        if not isinstance(arg, ast.Selector) or arg.metric is not None or arg.range_ms is not None or arg.offset_ms or arg.at:
            raise TypeMismatch("info takes a plain label selector")
        matchers = arg.matchers
        if not any(m.name == "__name__" for m in matchers):
            matchers = (ast.Matcher("__name__", "=", "target_info"), *matchers)
    wanted = tuple(m.name for m in matchers if m.name != "__name__")
    df = c.run.vector(ast.Selector(None, matchers), c.grid).df
    df = df.where(has_label(F.col("labels"), "job") & has_label(F.col("labels"), "instance"))
    job, instance = label(F.col("labels"), "job"), label(F.col("labels"), "instance")
    data = drop_labels(F.col("labels"), ("job", "instance"))
    if wanted:
        data = F.filter(data, lambda x: x["name"].isin(list(wanted)))
    keyed = df.select("step_ts", "metric", job.alias("_j"), instance.alias("_i"), "ts", data.alias("d"))
    newest = keyed.groupBy("step_ts", "metric", "_j", "_i").agg(F.max_by("d", "ts").alias("d"))
    pairs = newest.select("step_ts", "_j", "_i", F.explode("d").alias("l"))
    least = pairs.groupBy("step_ts", "_j", "_i", F.col("l.name").alias("name")).agg(F.min("l.value").alias("value"))
    extra = least.groupBy("step_ts", "_j", "_i").agg(F.collect_list(F.struct("name", "value")).alias("_x"))
    v = c.vector(0).df.withColumns({"_j": job, "_i": instance})
    named = has_label(F.col("labels"), "job") & has_label(F.col("labels"), "instance")
    out = v.join(extra, ["step_ts", "_j", "_i"], "left")
    kept = F.filter("labels", lambda x: ~F.array_contains(F.transform("_x", lambda y: y["name"]), x["name"]))
    merged = F.array_sort(F.concat(kept, F.filter("_x", lambda x: x["value"] != "")))
    return Vector(out.withColumn("labels", F.when(named & F.col("_x").isNotNull(), merged).otherwise(F.col("labels"))).drop("_j", "_i", "_x"))


def _histogram_quantile(c: _Call):
    c.count(2)
    v = c.vector(1)
    bound = F.lower(label(F.col("labels"), "le"))
    le = F.when(bound.isin("+inf", "inf"), I.lit(I.INF)).when(bound == "-inf", I.lit(-I.INF)).otherwise(bound.try_cast("double"))
    df = v.df.where(F.col("hist").isNull()) if c.run.hist else v.df
    rows = df.withColumn("_le", le).where(F.col("_le").isNotNull())
    rows = rows.withColumns({"metric": F.regexp_replace("metric", "_bucket$", ""), "labels": drop_labels(F.col("labels"), ("le",))})
    grouped = rows.groupBy(*ID).agg(F.array_sort(F.collect_list(F.struct(F.col("_le").alias("le"), F.col("value").alias("n")))).alias("b"), F.max("ts").alias("ts"))
    grouped, phi = c.number(0, grouped)
    out = grouped.withColumn("value", H.classic_quantile(F.col("b"), phi))
    if not c.run.hist:
        return Vector(out.select(*ID, "ts", "value"))
    none = F.lit(None).cast(v.df.schema["hist"].dataType)
    native, phi2 = c.number(0, v.df.where(F.col("hist").isNotNull()))
    native = native.withColumn("value", H.quantile(F.col("hist"), phi2))
    return Vector(out.select(*ID, "ts", "value", none.alias("hist")).unionByName(native.select(*ID, "ts", "value", none.alias("hist"))))


def _histogram_part(c: _Call):
    c.count(1)
    v = c.vector(0)
    if not c.run.hist:
        return Vector(v.df.where("false"))
    h = F.col("hist")
    value = {"histogram_count": H.count(h), "histogram_sum": h["sum"], "histogram_avg": I.fdiv(h["sum"], H.count(h))}[c.name]
    df = v.df.where(h.isNotNull()).withColumn("value", value)
    return Vector(df.withColumn("hist", F.lit(None).cast(v.df.schema["hist"].dataType)))


def _histogram_none(c: _Call):
    """Nothing for floats, an error for native histograms."""
    c.count(3 if c.name == "histogram_fraction" else 1)
    v = c.vector(2 if c.name == "histogram_fraction" else 0)
    return Vector(c.run.no_hist(v.df, c.name).where("false"))


OTHERS: dict[str, Callable[[_Call], object]] = {
    "quantile_over_time": _quantile_over_time,
    "mad_over_time": _mad_over_time,
    "predict_linear": _predict_linear,
    "double_exponential_smoothing": _smoothing,
    "holt_winters": _smoothing,
    "absent": _absent,
    "absent_over_time": _absent,
    "round": _round,
    "clamp": _clamp,
    "clamp_min": _clamp_one,
    "clamp_max": _clamp_one,
    "pi": _pi,
    "time": _time,
    "timestamp": _timestamp,
    "scalar": _scalar,
    "count_scalar": _count_scalar,
    "vector": _vector,
    "sort": _sort,
    "sort_desc": _sort,
    "sort_by_label": _sort_by_label,
    "sort_by_label_desc": _sort_by_label,
    "drop_common_labels": _drop_common,
    "label_replace": _label_replace,
    "label_join": _label_join,
    "info": _info,
    "histogram_quantile": _histogram_quantile,
    "histogram_count": _histogram_part,
    "histogram_sum": _histogram_part,
    "histogram_avg": _histogram_part,
    "histogram_stddev": _histogram_none,
    "histogram_stdvar": _histogram_none,
    "histogram_fraction": _histogram_none,
}
