"""Query text to one DataFrame plan.

Every evaluation step is a row: frames carry ``step_ts`` and no step is looped
over on the driver. A sample is placed on the steps it serves by arithmetic on
its time, so there is no join between steps and samples; grouping by (step,
identity) combines on the map side, however large one series is.

Errors that depend on data (many-to-many matches, mixed histograms) are kept
as *guards*, small frames of offending rows that ``instant`` and ``range`` look
at before they hand out the result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import EvalError, TypeMismatch
from ..functions import ieee as I
from ..functions.hashes import canonical_column, hasher
from ..functions.patterns import anchored, literals
from ..model import LABELS, drop_labels, keep_labels, label, set_label
from ..operators import histogram as H
from ..operators import ranges as R
from ..session import ship
from . import ast
from .parser import COMPARISONS, SET_OPS, parse
from .values import Buckets, Grid, Range, Scalar, Text, Vector

I64_MIN, I64_MAX = -(1 << 63), (1 << 63) - 1
ID = ["step_ts", "metric", "labels"]


def clamp(x: int) -> int:
    return max(I64_MIN, min(I64_MAX, x))


def floor_div(a: Column, b: int) -> Column:
    """Exact floor division of BIGINT by a positive constant."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


class Engine:
    """Evaluates queries over a samples frame (see ``model``).

    ``units`` is how many time units a second has; ``series`` may give the
    distinct (metric, labels) as a small table, which the exact-match rule then
    reads instead of the samples.
    """

    def __init__(self, samples: DataFrame, *, units: int = 1000, lookback_ms: int = 300_000, series: DataFrame | None = None):
        self.samples, self.units, self.series = samples, units, series
        self.spark: SparkSession = samples.sparkSession
        self.lookback = self.to_units(lookback_ms)
        self.hist = "hist" in samples.columns
        self.payload = ["value", "hist"] if self.hist else ["value"]
        ship(self.spark)

    def to_units(self, ms: int) -> int:
        return clamp(ms * self.units // 1000 if ms >= 0 else -(-ms * self.units // 1000))

    # entry points

    def instant(self, query: str, at: int) -> DataFrame:
        """(metric, labels, ts, value[, hist]); of a range vector all points; of a scalar one row; of a string its text."""
        run = _Run(self, Grid(at, 1, 1), at, at, None)
        out = run.eval(parse(query), run.grid)
        run.settle_guards()
        if isinstance(out, Scalar):
            return run.scalar_frame(out, run.grid).select(F.lit("").alias("metric"), F.array().cast(LABELS).alias("labels"), F.col("step_ts").alias("ts"), "value")
        if isinstance(out, Text):
            return self.spark.range(1).select(F.lit(at).cast("long").alias("ts"), F.lit(out.value).alias("text"))
        if isinstance(out, Range):
            return out.df.select("metric", "labels", F.col("p_ts").alias("ts"), *self.payload)
        return out.df.select("metric", "labels", "ts", *self.payload)

    def range(self, query: str, start: int, end: int, step: int) -> DataFrame:
        """(metric, labels, ts, value[, hist]) with ts the step."""
        if step <= 0:
            raise EvalError("step must be positive")
        if start > end:
            raise EvalError("start is after end")
        run = _Run(self, Grid(start, step, (end - start) // step + 1), start, end, step)
        out = run.eval(parse(query), run.grid)
        run.settle_guards()
        if isinstance(out, Text):
            return run.steps(run.grid).where("false").select(F.lit("").alias("metric"), F.array().cast(LABELS).alias("labels"), F.col("step_ts").alias("ts"), F.lit(0.0).alias("value"))
        if isinstance(out, Scalar):
            return run.scalar_frame(out, run.grid).select(F.lit("").alias("metric"), F.array().cast(LABELS).alias("labels"), F.col("step_ts").alias("ts"), "value")
        if isinstance(out, Range):
            last = F.max_by(F.struct(*self.payload), F.struct("p_ts", "seq")).alias("p")
            df = out.df.groupBy(*ID).agg(last)
            return df.select("metric", "labels", F.col("step_ts").alias("ts"), *[F.col(f"p.{c}").alias(c) for c in self.payload])
        return out.df.select("metric", "labels", F.col("step_ts").alias("ts"), *self.payload)

    def selectors(self, query: str) -> list[ast.Selector]:
        """All selectors of a query, outermost first."""
        found: list[ast.Selector] = []

        def walk(e: object) -> None:
            if isinstance(e, ast.Selector):
                found.append(e)
            elif isinstance(e, ast.Expr):
                for v in vars(e).values():
                    for x in v if isinstance(v, tuple) else (v,):
                        walk(x)

        walk(parse(query))
        return found

    # selection

    def matched(self, metric: str | None, matchers: tuple[ast.Matcher, ...], *, exact: bool = True) -> DataFrame:
        """Samples of the selected series.

        If all matchers are equalities and a series with exactly those labels
        exists at any time, it alone is selected.
        """
        df = self.samples
        if metric is not None:
            df = df.where(F.col("metric") == metric)
        if exact and metric is not None and all(m.op == "=" and m.name != "__name__" for m in matchers):
            own = sorted({(m.name, m.value) for m in matchers})
            if len({n for n, _ in own}) == len(own):
                want = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in own]).cast(LABELS)
                # labels kept as columns make this a pushed filter too, so no more than the matching rows are looked through
                table = self.series.where(F.col("metric") == metric) if self.series is not None else self._filtered(df, matchers)
                if table.where(F.col("labels") == want).limit(1).count():
                    return self._filtered(df, matchers).where(F.col("labels") == want)
        return self._filtered(df, matchers)

    def _filtered(self, df: DataFrame, matchers: tuple[ast.Matcher, ...]) -> DataFrame:
        for m in matchers:
            df = df.where(self.condition(m))
        return df

    def condition(self, m: ast.Matcher) -> Column:
        if m.name == "__name__":
            value = F.col("metric")
        elif f"label_{m.name}" in self.samples.columns:
            value = F.coalesce(F.col(f"label_{m.name}"), F.lit("")) if m.op in ("!=", "!~") or m.value == "" or m.op == "=~" and "" in (literals(m.value) or [""]) else F.col(f"label_{m.name}")
        else:
            value = label(F.col("labels"), m.name)
        if m.op == "=":
            return value == m.value
        if m.op == "!=":
            return value != m.value
        return anchored(value, m.value) if m.op == "=~" else ~anchored(value, m.value)


class _Run:
    """One query: memo of evaluated subexpressions, and guards."""

    def __init__(self, engine: Engine, grid: Grid, start: int, end: int, step: int | None):
        self.engine, self.grid, self.start, self.end = engine, grid, start, end
        self.step = step if step is not None else engine.to_units(60_000)
        self.payload, self.hist, self.units = engine.payload, engine.hist, engine.units
        self.memo: dict = {}
        self.guards: list[tuple[DataFrame, str]] = []

    # frames

    def steps(self, grid: Grid) -> DataFrame:
        return self.engine.spark.range(grid.n).select((F.col("id") * grid.step + grid.start).alias("step_ts"))

    def scalar_frame(self, s: Scalar, grid: Grid) -> DataFrame:
        return s.df if s.df is not None else self.steps(grid).withColumn("value", I.lit(s.const))

    def guard(self, df: DataFrame, message: str) -> None:
        self.guards.append((df.limit(1), message))

    def settle_guards(self) -> None:
        """One job looks at all guards."""
        if self.guards:
            found = [df.select(F.lit(message).alias("m")) for df, message in self.guards]
            for row in functools.reduce(DataFrame.union, found).limit(1).collect():
                raise EvalError(row.m)

    def no_hist(self, df: DataFrame, what: str) -> DataFrame:
        """Guards that no row holds a histogram, and drops the column's content."""
        if not self.hist:
            return df
        self.guard(df.where(F.col("hist").isNotNull()), f"{what} takes no histograms")
        return df.withColumn("hist", F.lit(None).cast(df.schema["hist"].dataType))

    def fixed(self, at: ast.At) -> int:
        if at.where == "start":
            return self.start
        if at.where == "end":
            return self.end
        return clamp(int(math.floor(abs(at.where) * self.units + 0.5)) * (1 if at.where >= 0 else -1))

    def eval(self, e: ast.Expr, grid: Grid):
        key = (e, grid)
        if key not in self.memo:
            self.memo[key] = self._eval(e, grid)
        return self.memo[key]

    def _eval(self, e: ast.Expr, grid: Grid):
        if isinstance(e, ast.Number):
            return Scalar(const=e.value)
        if isinstance(e, ast.Text):
            return Text(e.value)
        if isinstance(e, ast.Selector):
            return self.matrix(e, grid) if e.range_ms is not None else self.vector(e, grid)
        if isinstance(e, ast.Subquery):
            return self.subquery(e, grid)
        if isinstance(e, ast.Unary):
            return self.unary(e, grid)
        if isinstance(e, ast.Binary):
            return self.binary(e, grid)
        if isinstance(e, ast.Aggregate):
            return self.aggregate(e, grid)
        return self.call(e, grid)

    # selectors

    def spread(self, df: DataFrame, low: Column, high: Column, grid: Grid) -> DataFrame:
        """A row for each step number in [low, high] of the grid, as ``step_ts``."""
        lo, hi = F.greatest(low, F.lit(0).cast("long")), F.least(high, F.lit(grid.n - 1).cast("long"))
        df = df.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
        k = F.explode(F.sequence("_lo", "_hi"))
        return df.withColumn("_k", k).withColumn("step_ts", F.col("_k") * grid.step + grid.start).drop("_lo", "_hi", "_k")

    def times(self, e, grid: Grid) -> tuple[Grid, int]:
        """The grid that a selector reads at, and how far before it."""
        offset = self.engine.to_units(e.offset_ms)
        return (Grid(self.fixed(e.at), grid.step, 1) if e.at is not None else grid), offset

    def over(self, df: DataFrame, e, grid: Grid, own: Grid) -> DataFrame:
        """Repeats what was read at a fixed time on every step."""
        if e.at is None:
            return df
        every = F.explode(F.sequence(F.lit(grid.start).cast("long"), F.lit(grid.last).cast("long"), F.lit(grid.step).cast("long")))
        return df.withColumn("step_ts", every)

    def placed(self, e: ast.Selector, own: Grid, offset: int, back: int, closed: bool) -> DataFrame:
        """Matched samples on the steps whose window of ``back`` units holds them."""
        df = self.engine.matched(e.metric, e.matchers)
        first, last = clamp(own.start - offset - back), clamp(own.last - offset)
        df = df.where((F.col("ts") >= first if closed else F.col("ts") > first) & (F.col("ts") <= last))
        if own.n == 1:
            return df.withColumn("step_ts", F.lit(own.start).cast("long"))
        since = F.col("ts") + F.lit(offset - own.start)
        low = floor_div(since + F.lit(own.step - 1), own.step)
        high = floor_div(since + F.lit(back if closed else back - 1), own.step)
        return self.spread(df, low, high, own)

    def vector(self, e: ast.Selector, grid: Grid) -> Vector:
        own, offset = self.times(e, grid)
        df = self.placed(e, own, offset, self.engine.lookback, True)
        last = F.max_by(F.struct("ts", "is_stale", *self.payload), F.struct("ts", (-F.col("seq")).alias("o"))).alias("p")
        df = df.groupBy(*ID).agg(last).where("not p.is_stale")
        df = df.select(*ID, *[F.col(f"p.{c}").alias(c) for c in ("ts", *self.payload)])
        return Vector(self.over(df, e, grid, own))

    def matrix(self, e: ast.Selector, grid: Grid) -> Range:
        own, offset = self.times(e, grid)
        back = self.engine.to_units(e.range_ms)
        df = self.placed(e, own, offset, back, False).where("not is_stale")
        df = df.select(*ID, F.col("ts").alias("p_ts"), "seq", *self.payload)
        hi = (lambda s: s - offset) if e.at is None else (lambda s: F.lit(clamp(own.start - offset)).cast("long"))
        return Range(self.over(df, e, grid, own), lambda s: hi(s) - back, hi)

    def bucketed(self, e: ast.Expr, grid: Grid) -> Buckets | None:
        """The samples of overlapping windows by buckets that each lie whole inside or outside of any window.

        A sample is then met once, and what is repeated on the steps it serves
        is a bucket's summary. None where windows do not overlap, or where such
        buckets would be many a step.
        """
        if not isinstance(e, ast.Selector) or e.range_ms is None or e.at is not None or self.hist or grid.n == 1:
            return None
        offset, back = self.engine.to_units(e.offset_ms), self.engine.to_units(e.range_ms)
        width = math.gcd(grid.step, back)
        if back <= grid.step or width * 8 < grid.step:
            return None
        df = self.engine.matched(e.metric, e.matchers).where("not is_stale")
        df = df.where((F.col("ts") > clamp(grid.start - offset - back)) & (F.col("ts") <= clamp(grid.last - offset)))
        bucket = floor_div(F.col("ts") + F.lit(offset - grid.start + width - 1), width)
        rows = df.select("metric", "labels", F.col("ts").alias("p_ts"), "seq", "value", bucket.alias("_b"))

        def spread(parts: DataFrame) -> DataFrame:
            low = floor_div(F.col("_b") * width + F.lit(grid.step - 1), grid.step)
            return self.spread(parts, low, floor_div((F.col("_b") - 1) * width + F.lit(back), grid.step), grid)

        return Buckets(rows, spread, lambda s: s - offset - back, lambda s: s - offset)

    def subquery(self, e: ast.Subquery, grid: Grid) -> Range:
        own, offset = self.times(e, grid)
        back = self.engine.to_units(e.range_ms)
        step = self.engine.to_units(e.step_ms) if e.step_ms is not None else self.step
        if step <= 0:
            raise EvalError("a subquery step must be positive")
        m = back // step
        # Inner times are anchored to each step's window, so windows fall into phases of an inner grid. One grid
        # that holds them all is read once; only where it would be many times as fine, each phase is its own.
        begin = own.start - offset - back
        fine = math.gcd(step, own.step) if own.n > 1 else step
        period = step // fine if own.n > 1 else 1
        phases: list[tuple[int, int, int]] = [(begin, own.last - offset - back + m * step, fine)]
        apart = []
        for k in range(min(period, own.n)):
            last_k = own.n - 1 - (own.n - 1 - k) % period
            apart.append((begin + k * own.step, begin + last_k * own.step + m * step, step))
            if len(apart) > 64:
                break
        if len(apart) <= 64 and sum((z - a) // s + 1 for a, z, s in apart) * 8 < (phases[0][1] - begin) // fine + 1:
            phases = apart
        parts: list[DataFrame] = []
        for first, last, inner_step in phases:
            inner = Grid(first, inner_step, (last - first) // inner_step + 1)
            v = self.eval(e.expr, inner)
            if isinstance(v, Scalar):
                df = self.scalar_frame(v, inner).select(F.col("step_ts").alias("p_ts"), F.lit("").alias("metric"), F.array().cast(LABELS).alias("labels"), *self.scalar_payload())
            elif isinstance(v, Vector):
                df = v.df.select(F.col("step_ts").alias("p_ts"), "metric", "labels", *self.payload)
            else:
                raise TypeMismatch("a subquery needs a scalar or an instant vector")
            parts.append(df)
        df = parts[0]
        for more in parts[1:]:
            df = df.unionByName(more)
        if own.n == 1:
            df = df.withColumn("step_ts", F.lit(own.start).cast("long"))
        else:
            since = F.col("p_ts") + F.lit(offset - own.start)
            low = floor_div(since + F.lit(own.step - 1), own.step)
            df = self.spread(df, low, floor_div(since + F.lit(back), own.step), own)
            df = df.where(F.pmod(F.col("p_ts") - (F.col("step_ts") - F.lit(offset + back)), F.lit(step)) == 0)
        df = df.select(*ID, "p_ts", F.lit(0).cast("long").alias("seq"), *self.payload)
        hi = (lambda s: s - offset) if e.at is None else (lambda s: F.lit(clamp(own.start - offset)).cast("long"))
        return Range(self.over(df, e, grid, own), lambda s: hi(s) - back, hi)

    def scalar_payload(self) -> list[Column]:
        return [F.col("value"), *([F.lit(None).cast(self.engine.samples.schema["hist"].dataType).alias("hist")] if self.hist else [])]

    # operators

    def unary(self, e: ast.Unary, grid: Grid):
        v = self.eval(e.expr, grid)
        if e.op == "+" or isinstance(v, Text):
            return v
        if isinstance(v, Scalar):
            return Scalar(const=-v.const) if v.const is not None else Scalar(df=v.df.withColumn("value", -F.col("value")))
        df = v.df.withColumn("value", -F.col("value"))
        if self.hist:
            df = df.withColumn("hist", F.when(F.col("hist").isNotNull(), H.scale(F.col("hist"), I.lit(-1))))
        return Range(df, v.lo, v.hi) if isinstance(v, Range) else Vector(df)

    ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
        "+": lambda a, b: a + b,
        "-": lambda a, b: a - b,
        "*": lambda a, b: a * b,
        "/": I.fdiv,
        "%": I.fmod,
        "^": I.fpow,
        "atan2": F.atan2,
        "==": I.feq,
        "!=": I.fne,
        "<": I.flt,
        ">": I.fgt,
        "<=": I.fle,
        ">=": I.fge,
    }

    def binary(self, e: ast.Binary, grid: Grid):
        a, b = self.eval(e.left, grid), self.eval(e.right, grid)
        if isinstance(a, Text | Range) or isinstance(b, Text | Range):
            raise TypeMismatch(f"{e.op} needs scalars or instant vectors")
        compare = e.op in COMPARISONS
        f = self.ARITHMETIC.get(e.op)
        if isinstance(a, Scalar) and isinstance(b, Scalar):
            if e.op in SET_OPS:
                raise TypeMismatch(f"{e.op} needs instant vectors")
            if compare and not e.bool_:
                raise TypeMismatch("comparisons of scalars need bool")
            one = self.scalar_frame(a, grid).withColumnRenamed("value", "x").join(self.scalar_frame(b, grid).withColumnRenamed("value", "y"), "step_ts")
            out = f(F.col("x"), F.col("y"))
            return Scalar(df=one.select("step_ts", (out.cast("double")).alias("value")))
        if isinstance(a, Scalar) or isinstance(b, Scalar):
            if e.op in SET_OPS:
                raise TypeMismatch(f"{e.op} needs instant vectors")
            left = isinstance(b, Scalar)
            v, s = (a, b) if left else (b, a)
            df = self.no_hist(v.df, e.op)
            if s.const is not None:
                df = df.withColumn("_s", I.lit(s.const))
            else:
                df = df.join(F.broadcast(s.df.withColumnRenamed("value", "_s")) if grid.n <= 100_000 else s.df.withColumnRenamed("value", "_s"), "step_ts")
            x, y = (F.col("value"), F.col("_s")) if left else (F.col("_s"), F.col("value"))
            out = f(x, y)
            if compare and not e.bool_:
                return Vector(df.where(out).drop("_s"))
            return Vector(df.withColumn("value", out.cast("double")).withColumn("metric", F.lit("")).drop("_s"))
        return self.vectors(e, a, b, grid)

    def vectors(self, e: ast.Binary, a: Vector, b: Vector, grid: Grid) -> Vector:
        m = e.matching or ast.Matching()

        def key(labels: Column) -> Column:
            return keep_labels(labels, m.labels) if m.on else drop_labels(labels, m.labels)

        left, right = a.df.withColumn("_key", key(F.col("labels"))), b.df.withColumn("_key", key(F.col("labels")))
        on = ["step_ts", "_key"]
        if e.op == "and":
            return Vector(left.join(right.select(*on).distinct(), on, "left_semi").drop("_key"))
        if e.op == "unless":
            return Vector(left.join(right.select(*on).distinct(), on, "left_anti").drop("_key"))
        if e.op == "or":
            more = right.join(left.select(*on).distinct(), on, "left_anti")
            return Vector(left.drop("_key").unionByName(more.drop("_key")))
        many_left, many_right = m.group == "left", m.group == "right"
        for side, many, name in ((left, many_left, "left"), (right, many_right, "right")):
            if not many:
                other = right if name == "left" else left
                twice = side.groupBy(*on).count().where("count > 1")
                self.guard(twice.join(other.select(*on), on, "left_semi"), f"many-to-many matching: repeated key on the {name} side")
        if self.hist:
            left, right = self.no_hist(left, e.op), self.no_hist(right, e.op)
        base, extra = (right, left) if many_right else (left, right)
        base = base.select("step_ts", "_key", F.col("metric").alias("metric"), F.col("labels"), F.col("ts"), F.col("value").alias("_bv"))
        extra = extra.select("step_ts", "_key", F.col("labels").alias("_xl"), F.col("ts").alias("_xt"), F.col("value").alias("_xv"))
        df = base.join(extra, on)
        labels = F.col("labels")
        for name in m.include:
            labels = set_label(labels, name, label(F.col("_xl"), name))
        x, y = (F.col("_xv"), F.col("_bv")) if many_right else (F.col("_bv"), F.col("_xv"))
        out = self.ARITHMETIC[e.op](x, y)
        compare = e.op in COMPARISONS
        keep = compare and not e.bool_
        if keep:
            df = df.where(out)
            value = y if many_right else x
            metric = F.lit("") if m.on and not many_right else F.col("metric")
        else:
            value, metric = out.cast("double"), F.lit("")
        cols = [F.greatest("ts", "_xt").alias("ts") if not keep else F.col("ts"), value.alias("value")]
        if self.hist:
            cols.append(F.lit(None).cast(self.engine.samples.schema["hist"].dataType).alias("hist"))
        return Vector(df.select("step_ts", metric.alias("metric"), labels.alias("labels"), *cols))

    # aggregation

    def parameter(self, e: ast.Expr, grid: Grid, df: DataFrame, name: str) -> tuple[DataFrame, Column]:
        """A scalar argument as a column of ``df``."""
        s = self.eval(e, grid)
        if not isinstance(s, Scalar):
            raise TypeMismatch(f"{name} needs a scalar")
        if s.const is not None:
            return df, I.lit(s.const)
        return df.join(s.df.withColumnRenamed("value", "_p"), "step_ts"), F.col("_p")

    def aggregate(self, e: ast.Aggregate, grid: Grid) -> Vector:
        v = self.eval(e.expr, grid)
        if not isinstance(v, Vector):
            raise TypeMismatch(f"{e.op} needs an instant vector")
        names = e.grouping or ()
        group = drop_labels(F.col("labels"), names) if e.without else keep_labels(F.col("labels"), names)
        df = v.df.withColumn("_g", group)
        by = ["step_ts", "_g"]
        if e.op in ("topk", "bottomk", "limitk", "limit_ratio"):
            return self.chosen(e, grid, df, by)
        if self.hist and e.op not in ("sum", "avg", "count", "group"):
            df = self.no_hist(df, e.op)
        x = F.col("value")
        real = F.when(~F.isnan(x), x)
        if e.op == "count_values":
            name = self.eval(e.param, grid)
            if not isinstance(name, Text):
                raise TypeMismatch("count_values needs a label name")
            df = df.withColumn("_g", set_label(F.col("_g"), name.value, I.number_text()(x)))
            out = F.count(F.lit(1)).cast("double")
        elif e.op == "quantile":
            df, phi = self.parameter(e.param, grid, df, "quantile")
            grouped = df.groupBy(*by).agg(F.collect_list("value").alias("v"), F.max("ts").alias("ts"), F.first(phi).alias("phi"))
            return self.grouped(grouped.withColumn("value", R.quantile(F.col("v"), F.col("phi"), nan_first=True)))
        else:
            out = {
                "sum": F.sum(x),
                "avg": F.avg(x),
                "min": F.coalesce(F.min(real), I.lit(I.NAN)),
                "max": F.coalesce(F.max(real), I.lit(I.NAN)),
                "count": F.count(F.lit(1)).cast("double"),
                "group": F.max(I.lit(1)),
                "stddev": F.stddev_pop(x),
                "stdvar": F.var_pop(x),
            }[e.op]
        cols = [out.alias("value"), F.max("ts").alias("ts")]
        if self.hist and e.op in ("sum", "avg"):
            mixed = df.groupBy(*by).agg(F.count("hist").alias("h"), F.count(F.lit(1)).alias("n"))
            self.guard(mixed.where("h > 0 and h < n"), f"{e.op} of floats and histograms")
            grouped = df.groupBy(*by).agg(*cols, F.collect_list("hist").alias("hs"))
            first = F.get("hs", F.lit(0))
            self.guard(grouped.where(F.exists("hs", lambda h: ~H.same_layout(h, first))), f"{e.op} of histograms with different buckets")
            whole = F.aggregate(F.slice("hs", F.lit(2), F.size("hs")), first, H.add)
            if e.op == "avg":
                whole = H.scale(whole, I.lit(1) / F.size("hs"))
            return self.grouped(grouped.withColumn("hist", F.when(F.size("hs") > 0, whole).cast(self.engine.samples.schema["hist"].dataType)))
        return self.grouped(df.groupBy(*by).agg(*cols))

    def grouped(self, df: DataFrame) -> Vector:
        if self.hist and "hist" not in df.columns:
            df = df.withColumn("hist", F.lit(None).cast(self.engine.samples.schema["hist"].dataType))
        return Vector(df.select("step_ts", F.lit("").alias("metric"), F.col("_g").alias("labels"), "ts", *self.payload))

    def chosen(self, e: ast.Aggregate, grid: Grid, df: DataFrame, by: list[str]) -> Vector:
        df, p = self.parameter(e.param, grid, df, e.op)
        df = df.withColumn("_k", p)
        x = F.col("value")
        if e.op in ("topk", "bottomk"):
            df = self.no_hist(df, e.op)
            order = [F.isnan(x), x.desc() if e.op == "topk" else x.asc(), "metric", "labels"]
        else:
            df = df.withColumn("_h", hasher("xxh64")(canonical_column(F.col("metric"), F.col("labels"))))
            order = [F.col("_h") < 0, "_h", "metric", "labels"]
        w = Window.partitionBy(*by)
        if e.op == "limit_ratio":
            self.guard(df.where(F.isnan("_k") | (F.col("_k") == 0) | (F.abs("_k") > 1)), "limit_ratio needs a ratio in [-1, 1] other than 0")
            df = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(*order)))
            take = F.floor(F.col("_n") * F.abs("_k"))
            df = df.where(F.when(F.col("_k") > 0, F.col("_r") <= take).otherwise(F.col("_r") > F.col("_n") - take))
        elif (const := self.eval(e.param, grid).const) is not None:
            # with a literal, ranks past it end before the shuffle
            k = 0 if math.isnan(const) or math.isinf(const) or const <= 0 else math.floor(min(const, 1e9))
            df = df.withColumn("_r", F.row_number().over(w.orderBy(*order))).where(F.col("_r") <= F.lit(k))
        else:
            k = F.when(F.isnan("_k") | (F.abs("_k") == I.INF) | (F.col("_k") <= 0), F.lit(0)).otherwise(F.floor(F.least("_k", I.lit(1e9))))
            df = df.withColumn("_r", F.row_number().over(w.orderBy(*order))).where(F.col("_r") <= k)
        return Vector(df.select(*ID, "ts", *self.payload))

    # functions

    def call(self, e: ast.Call, grid: Grid):
        from .calls import evaluate

        return evaluate(self, e, grid)


