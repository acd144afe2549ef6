"""The select API over a samples frame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..functions.hashes import canonical_column, hasher
from ..functions.patterns import anchored
from ..model import LABELS, label
from . import aggregations as A


def label_array(labels: dict[str, str]) -> Column:
    pairs = [F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in sorted(labels.items())]
    return F.array(*pairs).cast(LABELS) if pairs else F.array().cast(LABELS)


@dataclass
class Options:
    """A select with options; ``aggregation`` None passes points through, or means ``last`` when downsampling."""

    labels: dict[str, str] = field(default_factory=dict)
    start: int | None = None
    end: int | None = None
    aggregation: str | None = None
    interval: int | None = None
    custom: tuple | None = None
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Matcher:
    """``op`` is =, !=, =~ or !~; a missing label is ''; ``__name__`` is the metric."""

    name: str
    op: str
    value: str

    def column(self) -> Column:
        v = F.col("metric") if self.name == "__name__" else label(F.col("labels"), self.name)
        if self.op in ("=", "!="):
            return (v == self.value) if self.op == "=" else (v != self.value)
        if self.op in ("=~", "!~"):
            return anchored(v, self.value) if self.op == "=~" else ~anchored(v, self.value)
        raise InvalidRequest(f"unknown matcher {self.op!r}")


def within(df: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Points of the half-open range."""
    if start is not None and end is not None and start >= end:
        raise InvalidRequest("start must be before end")
    if start is not None:
        df = df.where(F.col("ts") >= start)
    return df.where(F.col("ts") < end) if end is not None else df


def series(df: DataFrame, metric: str, labels: dict[str, str]) -> DataFrame:
    return df.where((F.col("metric") == metric) & (F.col("labels") == label_array(labels)))


def select(df: DataFrame, metric: str, labels: dict[str, str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """(ts, value) of exactly this series in time order; no labels is the unlabeled series."""
    return within(series(df, metric, labels or {}), start, end).orderBy("ts", "seq").select("ts", "value")


def select_many(df: DataFrame, requests: list[tuple[str, dict[str, str]]], start: int | None = None, end: int | None = None) -> DataFrame:
    """(ordinal, metric, labels, points) in request order; a series without points has an empty array."""
    spark = df.sparkSession
    rows = [(i, m, sorted(ls.items())) for i, (m, ls) in enumerate(requests)]
    want = spark.createDataFrame(rows, f"ordinal int, metric string, labels {LABELS}")
    points = within(df, start, end).join(F.broadcast(want.select("metric", "labels").distinct()), ["metric", "labels"], "left_semi")
    packed = points.groupBy("metric", "labels").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "value"))).alias("raw"))
    packed = packed.select("metric", "labels", F.transform("raw", lambda p: F.struct(p["ts"].alias("ts"), p["value"].alias("value"))).alias("points"))
    empty = F.array().cast(packed.schema["points"].dataType)
    return want.join(packed, ["metric", "labels"], "left").select("ordinal", "metric", "labels", F.coalesce("points", empty).alias("points")).orderBy("ordinal")


def select_all(df: DataFrame, metric: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """(metric, labels, ts, value) of every series of a metric, ordered by labels and time."""
    return within(df.where(F.col("metric") == metric), start, end).orderBy("labels", "ts", "seq").select("metric", "labels", "ts", "value")


def paged(df: DataFrame, order: list, limit: int | None, offset: int) -> DataFrame:
    """Drops ``offset`` rows, then keeps ``limit``."""
    if offset < 0 or limit is not None and limit < 0:
        raise InvalidRequest("limit and offset must not be negative")
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def select_with_options(df: DataFrame, metric: str, o: Options) -> DataFrame:
    """(ts, value): aggregated or downsampled if asked, then offset, then limit."""
    if o.interval is not None and o.interval <= 0:
        raise InvalidRequest("the interval must be positive")
    if o.interval is not None and (o.start is None or o.end is None):
        raise InvalidRequest("downsampling needs start and end")
    points = within(series(df, metric, o.labels), o.start, o.end)
    if o.custom is not None:
        out = A.custom(points, *o.custom, interval=o.interval, origin=o.start or 0)
    elif o.interval is not None:
        out = A.downsample(points, o.interval, o.aggregation or "last", origin=o.start)
    elif o.aggregation is not None:
        out = A.whole(points, o.aggregation)
    else:
        return paged(points, ["ts", "seq"], o.limit, o.offset).select("ts", "value")
    return paged(out.select("ts", "value"), ["ts"], o.limit, o.offset)


def list_metrics(df: DataFrame) -> DataFrame:
    return df.select("metric", "labels").distinct()


def select_series(df: DataFrame, metric: str | None = None, matchers: tuple[Matcher, ...] = (), start: int | None = None, end: int | None = None) -> DataFrame:
    """Sorted (metric, labels) of series that match and, given a range, have a point in it."""
    if (start is None) != (end is None):
        raise InvalidRequest("give both start and end, or neither")
    out = df.where(F.col("metric") == metric) if metric is not None else df
    for m in matchers:
        out = out.where(m.column())
    return within(out, start, end).select("metric", "labels").distinct().orderBy("metric", "labels")


def identity_hash() -> Column:
    """FNV-1a of the canonical identity, as the unsigned value's bits."""
    return hasher("fnv1a")(canonical_column(F.col("metric"), F.col("labels")))


def with_shard(df: DataFrame, shards: int) -> DataFrame:
    """Adds ``shard``: the unsigned hash of the series modulo ``shards``, hashed once a series."""
    ids = df.select("metric", "labels").distinct().withColumn("_h", identity_hash())
    unsigned = F.col("_h").cast("decimal(20,0)") + F.when(F.col("_h") < 0, F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(0)
    return df.join(ids.select("metric", "labels", (unsigned % shards).cast("int").alias("shard")), ["metric", "labels"])


def in_shards(df: DataFrame, shards: int, wanted: list[int]) -> DataFrame:
    return with_shard(df, shards).where(F.col("shard").isin(wanted)).drop("shard")


def shard_digest(df: DataFrame, shards: int, start: int, end: int) -> DataFrame:
    """(shard, n_series, n_points, fingerprint) of the range.

    Points are hashed in Arrow batches; a series' points fold order-free, and
    series fold in the order of their keys, so equal content has equal
    fingerprints on any cluster.
    """
    own = with_shard(within(df, start, end), shards)
    raw = F.concat(F.col("ts").cast("string"), F.lit("|"), F.hex(F.col("value").cast("string").cast("binary"))).cast("binary")
    points = own.withColumn("_p", hasher("fnv1a")(raw)).groupBy("shard", "metric", "labels").agg(F.bit_xor("_p").alias("x"), F.sum(F.col("_p") % 1000003).alias("s"), F.count(F.lit(1)).alias("n"))
    key = F.concat(canonical_column(F.col("metric"), F.col("labels")), F.lit(b"|"), F.concat_ws("|", "x", "s", "n").cast("binary"))
    each = points.withColumn("_k", hasher("fnv1a")(key)).groupBy("shard").agg(F.count(F.lit(1)).alias("n_series"), F.sum("n").alias("n_points"), F.bit_xor("_k").alias("fingerprint"))
    return each


def scan_rows(df: DataFrame, start: int, end: int, *, limit: int, offset: int = 0) -> tuple[DataFrame, int | None]:
    """A page of rows in (metric, labels, time) order, and the next offset or None at the end.

    One row past the page is asked for, so the whole is never counted.
    """
    page = paged(within(df, start, end), ["metric", "labels", "ts", "seq"], limit + 1, offset).select("metric", "labels", "ts", "value")
    more = page.count() > limit
    return page.limit(limit), offset + limit if more else None


@dataclass(frozen=True)
class Page:
    """Rows (metric, labels, ts, value) of a scan, whether more follow, and where they start."""

    rows: DataFrame
    truncated: bool
    next_offset: int | None


def _scan(df: DataFrame, order: list, limit: int, offset: int) -> Page:
    page = paged(df, [*order, "ts", "seq"], limit + 1, offset).select("metric", "labels", "ts", "value")
    more = page.count() > limit
    return Page(page.limit(limit), more, offset + limit if more else None)


def _bounded(series: DataFrame, max_series: int | None) -> None:
    if max_series is not None and series.limit(max_series + 1).count() > max_series:
        raise InvalidRequest(f"more than {max_series} series")


def scan_series_rows(df: DataFrame, requests: list[tuple[str, dict[str, str]]], start: int, end: int, *, limit: int, offset: int = 0, max_series: int | None = None) -> Page:
    """A page of the rows in [start, end) of the series asked for, in the order of the requests, then of time."""
    if max_series is not None and len(requests) > max_series:
        raise InvalidRequest(f"more than {max_series} series")
    spark = df.sparkSession
    seen: dict = {}
    for metric, labels in requests:
        seen.setdefault((metric, tuple(sorted(labels.items()))), len(seen))
    asked = [(i, m, [list(x) for x in pairs]) for (m, pairs), i in seen.items()]
    wanted = spark.createDataFrame(asked, "ordinal int, metric string, pairs array<array<string>>")
    wanted = wanted.select("ordinal", "metric", F.transform("pairs", lambda x: F.struct(x[0].alias("name"), x[1].alias("value"))).cast(LABELS).alias("labels"))
    return _scan(within(df, start, end).join(F.broadcast(wanted), ["metric", "labels"]), ["ordinal"], limit, offset)


def scan_metric_rows(df: DataFrame, metric: str, start: int, end: int, *, limit: int, offset: int = 0, max_series: int | None = None) -> Page:
    """A page of the rows in [start, end) of every series of a metric, by labels and time."""
    own = within(df.where(F.col("metric") == metric), start, end)
    _bounded(own.select("labels").distinct(), max_series)
    return _scan(own, ["labels"], limit, offset)


def scan_shard_window_rows(df: DataFrame, shards: int, shard: int, start: int, end: int, *, limit: int, offset: int = 0, max_series: int | None = None) -> Page:
    """A page of the rows in [start, end) of a shard's series, by series and time."""
    if not 0 <= shard < shards:
        raise InvalidRequest("no such shard")
    own = in_shards(within(df, start, end), shards, [shard])
    _bounded(own.select("metric", "labels").distinct(), max_series)
    return _scan(own, ["metric", "labels"], limit, offset)


def select_into(buffer: list, df: DataFrame, metric: str, labels: dict[str, str] | None = None, start: int | None = None, end: int | None = None) -> int:
    """Replaces a caller's list by the (ts, value) points of a series, and says how many. The points come to the driver."""
    buffer[:] = [(r.ts, r.value) for r in select(df, metric, labels, start, end).collect()]
    return len(buffer)
