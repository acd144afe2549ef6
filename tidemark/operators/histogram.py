"""Native (exponential) histograms as expressions over the ``hist`` struct.

Buckets are kept as spans of indexes and absolute counts. Values with integer
deltas are turned into counts where they are read (``from_deltas``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.ieee import INF, NAN, lit

FIELDS = ("count", "sum", "schema", "zero_threshold", "zero_count", "negative_spans", "negative_counts", "positive_spans", "positive_counts", "reset_hint", "custom_values")


def from_deltas(deltas: Column) -> Column:
    """Absolute counts from integer deltas."""
    zero = F.struct(F.array().cast("array<double>").alias("out"), lit(0).alias("run"))
    step = lambda s, d: F.struct(F.concat(s["out"], F.array(s["run"] + d)).alias("out"), (s["run"] + d).alias("run"))
    return F.aggregate(F.transform(deltas, lambda d: d.cast("double")), zero, step, lambda s: s["out"])


def with_fields(h: Column, **new: Column) -> Column:
    return F.struct(*[(new.get(k, h[k])).alias(k) for k in FIELDS])


def total(counts: Column) -> Column:
    return F.aggregate(F.coalesce(counts, F.array().cast("array<double>")), lit(0), lambda a, x: a + x)


def count(h: Column) -> Column:
    return F.coalesce(h["count"], total(h["negative_counts"]) + total(h["positive_counts"]) + F.coalesce(h["zero_count"], lit(0)))


def plain(out: Column, *hists: Column) -> Column:
    """``out``, or an error where a histogram has custom buckets: of these only counts and sums are read."""
    own = F.lit(False)
    for h in hists:
        own = own | (F.size(F.coalesce(h["custom_values"], F.array().cast("array<double>"))) > 0)
    return F.when(own, F.raise_error(F.lit("histograms with custom buckets are not supported here"))).otherwise(out)


def same_layout(a: Column, b: Column) -> Column:
    out = F.lit(True)
    for k in ("schema", "zero_threshold", "negative_spans", "positive_spans", "custom_values"):
        out = out & a[k].eqNullSafe(b[k])
    return out


def _merge(a: Column, b: Column, f) -> Column:
    both = lambda k: F.zip_with(a[k], b[k], lambda x, y: f(x, y))
    out = with_fields(
        a,
        count=f(count(a), count(b)),
        sum=f(a["sum"], b["sum"]),
        zero_count=f(F.coalesce(a["zero_count"], lit(0)), F.coalesce(b["zero_count"], lit(0))),
        negative_counts=both("negative_counts"),
        positive_counts=both("positive_counts"),
        reset_hint=F.when(a["reset_hint"] == b["reset_hint"], a["reset_hint"]).otherwise(F.lit("Unknown")),
    )
    return plain(out, a, b)


def add(a: Column, b: Column) -> Column:
    return _merge(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return _merge(a, b, lambda x, y: x - y)


def scale(h: Column, by: Column) -> Column:
    each = lambda k: F.transform(h[k], lambda x: x * by)
    out = with_fields(h, count=count(h) * by, sum=h["sum"] * by, zero_count=F.coalesce(h["zero_count"], lit(0)) * by, negative_counts=each("negative_counts"), positive_counts=each("positive_counts"))
    return plain(out, h)


def was_reset(now: Column, before: Column) -> Column:
    fell = lambda k: F.exists(F.zip_with(now[k], before[k], lambda x, y: x < y), lambda x: F.coalesce(x, F.lit(True)))
    less = (count(now) < count(before)) | (F.coalesce(now["zero_count"], lit(0)) < F.coalesce(before["zero_count"], lit(0))) | (now["sum"] < before["sum"])
    return (now["reset_hint"] == "Yes") | ~same_layout(now, before) | less | fell("negative_counts") | fell("positive_counts")


def increase(hpts: Column) -> Column:
    """Increase over sorted (ts, hist) points, resets included."""
    first = F.get(hpts, F.lit(0))["hist"]
    zero = F.struct(scale(first, lit(0)).alias("acc"), first.alias("prev"))

    def step(s: Column, p: Column) -> Column:
        gain = F.when(was_reset(p["hist"], s["prev"]), p["hist"]).otherwise(sub(p["hist"], s["prev"]))
        return F.struct(add(s["acc"], gain).alias("acc"), p["hist"].alias("prev"))

    return F.aggregate(F.slice(hpts, F.lit(2), F.size(hpts)), zero, step, lambda s: s["acc"])


def indexes(spans: Column) -> Column:
    """Bucket index of each count; a span starts ``offset`` past the end of the one before."""
    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, span: Column) -> Column:
        lo = (s["at"] + span["offset"]).cast("int")
        hi = (lo + span["length"]).cast("int")
        run = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
        return F.struct(F.concat(s["out"], run).alias("out"), hi.alias("at"))

    return F.aggregate(F.coalesce(spans, F.array().cast("array<struct<offset:int,length:bigint>>")), zero, step, lambda s: s["out"])


def buckets(h: Column) -> Column:
    """(lo, hi, n) of all non-empty buckets in order of value."""
    g = F.pow(lit(2), F.pow(lit(2), -h["schema"].cast("double")))
    empty = F.array().cast("array<struct<lo:double,hi:double,n:double>>")
    up = F.zip_with(indexes(h["positive_spans"]), h["positive_counts"], lambda i, n: F.struct(F.pow(g, i.cast("double")).alias("lo"), F.pow(g, i + lit(1)).alias("hi"), n.alias("n")))
    down = F.zip_with(indexes(h["negative_spans"]), h["negative_counts"], lambda i, n: F.struct((-F.pow(g, i + lit(1))).alias("lo"), (-F.pow(g, i.cast("double"))).alias("hi"), n.alias("n")))
    middle = F.array(F.struct((-h["zero_threshold"]).alias("lo"), h["zero_threshold"].alias("hi"), F.coalesce(h["zero_count"], lit(0)).alias("n")))
    every = F.concat(F.coalesce(down, empty), middle, F.coalesce(up, empty))
    return plain(F.array_sort(F.filter(every, lambda b: b["n"] > 0)), h)


def quantile(h: Column, phi: Column) -> Column:
    """Linear interpolation in the bucket that holds rank phi * total."""
    b = buckets(h)
    all_ = F.aggregate(b, lit(0), lambda a, x: a + x["n"])
    rank = phi * all_
    zero = F.struct(lit(0).alias("run"), F.lit(None).cast("double").alias("out"))

    def step(s: Column, x: Column) -> Column:
        hit = s["out"].isNull() & (rank <= s["run"] + x["n"])
        inside = x["lo"] + (x["hi"] - x["lo"]) * ((rank - s["run"]) / x["n"])
        return F.struct((s["run"] + x["n"]).alias("run"), F.when(hit, inside).otherwise(s["out"]).alias("out"))

    found = F.aggregate(b, zero, step, lambda s: F.coalesce(s["out"], F.get(b, F.size(b) - 1)["hi"]))
    return F.when(F.isnan(phi), lit(NAN)).when(phi < 0, lit(-INF)).when(phi > 1, lit(INF)).when(F.coalesce(all_, lit(0)) <= 0, lit(NAN)).otherwise(found)


def classic_quantile(b: Column, phi: Column) -> Column:
    """Quantile of sorted (le, n) cumulative buckets; NaN without +Inf or with fewer than two."""
    zero = F.struct(F.array().cast("array<struct<le:double,n:double>>").alias("out"), lit(-INF).alias("top"))

    def grow(s: Column, x: Column) -> Column:
        n = F.when(x["n"] < s["top"], s["top"]).otherwise(x["n"])
        return F.struct(F.concat(s["out"], F.array(F.struct(x["le"].alias("le"), n.alias("n")))).alias("out"), n.alias("top"))

    mono = F.aggregate(b, zero, grow, lambda s: s["out"])
    last, below = F.element_at(mono, -1), F.get(mono, F.size(mono) - 2)["le"]
    rank = phi * last["n"]
    start = F.struct(lit(0).alias("le"), lit(0).alias("n"), F.lit(None).cast("double").alias("out"), F.lit(True).alias("first"))

    def step(s: Column, x: Column) -> Column:
        hit = s["out"].isNull() & (rank <= x["n"])
        own = x["n"] - s["n"]
        inside = s["le"] + (x["le"] - s["le"]) * ((rank - s["n"]) / F.when(own > 0, own))
        low = F.when((x["le"] <= 0) | (x["n"] <= 0), x["le"]).otherwise(x["le"] * (rank / F.when(x["n"] > 0, x["n"])))
        value = F.when(s["first"], low).when(own <= 0, x["le"]).otherwise(inside)
        return F.struct(x["le"].alias("le"), x["n"].alias("n"), F.when(hit, value).otherwise(s["out"]).alias("out"), F.lit(False).alias("first"))

    found = F.aggregate(mono, start, step, lambda s: F.coalesce(s["out"], below))
    bad = (F.size(b) < 2) | (F.element_at(F.when(F.size(b) > 0, b), -1)["le"] != INF) | F.isnan(last["n"]) | (last["n"] == INF) | (last["n"] <= 0)
    special = F.when(F.isnan(phi), lit(NAN)).when(phi < 0, lit(-INF)).when(phi > 1, lit(INF)).when(F.coalesce(bad, F.lit(True)), lit(NAN))
    return special.when(rank >= last["n"], below).otherwise(found)
