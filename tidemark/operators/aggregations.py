"""Aggregations of the select API, over whole series and over buckets.

NaN is skipped by all but First and Last. Every aggregation is one Spark
aggregate that combines on the map side, so a bucket or series of any size is
no single task's load; Median alone gathers a group's values.
"""

from __future__ import annotations

import tempfile
from array import array
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRequest, UnsupportedAggregation
from ..session import ship

I64_MIN, I64_MAX = -(1 << 63), (1 << 63) - 1
U64_MAX = (1 << 64) - 1


def _real(v: Column, kind: str) -> Column:
    return F.when(~F.isnan(v), v) if kind == "f64" else v


def _time() -> Column:
    return F.struct("ts", "seq")


def _extreme(name: str, v: Column, kind: str) -> Column:
    """The least or greatest value, -0.0 below 0.0, at the first of equal ones."""
    real = _real(v, kind)
    sign = F.when(v.cast("string") == "-0.0", 0).otherwise(1) if kind == "f64" else F.lit(0)
    return F.min_by(F.col("value"), F.when(real.isNotNull(), F.struct(real, sign, _time()))) if name == "min" else F.max_by(F.col("value"), F.when(real.isNotNull(), F.struct(real, sign, (-F.col("ts")), (-F.col("seq")))))


def _clamped(x: Column, kind: str) -> Column:
    lo, hi = (I64_MIN, I64_MAX) if kind == "i64" else (0, U64_MAX)
    return F.least(F.greatest(x, F.lit(str(lo)).cast("decimal(38,0)")), F.lit(str(hi)).cast("decimal(38,0)")).cast("bigint" if kind == "i64" else "decimal(20,0)")


def _sum(v: Column, kind: str) -> Column:
    if kind == "f64":
        return F.sum(_real(v, kind))
    return _clamped(F.sum(v.cast("decimal(28,0)")), kind)


def _range(v: Column, kind: str) -> Column:
    if kind == "f64":
        return F.max(_real(v, kind)) - F.min(_real(v, kind))
    return _clamped(F.max(v.cast("decimal(38,0)")) - F.min(v.cast("decimal(38,0)")), kind)


#: name to (value column, kind) -> aggregate.
AGGREGATIONS: dict[str, Callable[[Column, str], Column]] = {
    "sum": _sum,
    "min": lambda v, k: _extreme("min", v, k),
    "max": lambda v, k: _extreme("max", v, k),
    "avg": lambda v, k: F.avg(_real(v, k).cast("double")),
    "first": lambda v, k: F.min_by(v, _time()),
    "last": lambda v, k: F.max_by(v, _time()),
    "count": lambda v, k: F.count(_real(v, k)),
    "median": lambda v, k: F.percentile(_real(v, k).cast("double"), 0.5),
    "range": _range,
    "variance": lambda v, k: F.var_pop(_real(v, k).cast("double")),
    "stddev": lambda v, k: F.stddev_pop(_real(v, k).cast("double")),
}
NUMERIC = ("sum", "avg", "median", "range", "variance", "stddev")


def kind_of(df: DataFrame) -> str:
    t = df.schema["value"].dataType.simpleString()
    return {"double": "f64", "float": "f64", "bigint": "i64", "int": "i64", "decimal(20,0)": "u64"}.get(t, t)


def aggregate(name: str, df: DataFrame) -> Column:
    kind = kind_of(df)
    if name not in AGGREGATIONS:
        raise InvalidRequest(f"unknown aggregation {name!r}")
    if name in NUMERIC and kind not in ("f64", "i64", "u64") or kind.startswith("struct") and name in ("min", "max"):
        raise UnsupportedAggregation(f"{name} of {kind} values")
    return AGGREGATIONS[name](F.col("value"), kind)


def bucket_start(ts: Column, interval: int, origin: int = 0) -> Column:
    """origin + floor((ts - origin) / interval) * interval."""
    return ts - F.pmod(ts - F.lit(origin), F.lit(interval))


def downsample(df: DataFrame, interval: int, name: str = "last", *, origin: int = 0, by: tuple[str, ...] = ("metric", "labels")) -> DataFrame:
    """(by..., ts, value) with ts the bucket's start; empty buckets, and those of NaN alone, have no row."""
    if interval <= 0:
        raise InvalidRequest("the interval must be positive")
    out = df.withColumn("_b", bucket_start(F.col("ts"), interval, origin)).groupBy(*by, "_b").agg(aggregate(name, df).alias("value"))
    return out.select(*by, F.col("_b").alias("ts"), "value").where(F.col("value").isNotNull())


def whole(df: DataFrame, name: str, *, by: tuple[str, ...] = ("metric", "labels")) -> DataFrame:
    """(by..., ts, value): one row a series at its last point's time; first, min and max keep their own."""
    at = F.max("ts")
    kind = kind_of(df)
    if name == "first":
        at = F.min("ts")
    elif name in ("min", "max"):
        v = F.col("value")
        real = _real(v, kind)
        sign = F.when(v.cast("string") == "-0.0", 0).otherwise(1) if kind == "f64" else F.lit(0)
        key = F.when(real.isNotNull(), F.struct(real, sign, "ts", "seq") if name == "min" else F.struct(real, sign, -F.col("ts"), -F.col("seq")))
        at = F.min_by("ts", key) if name == "min" else F.max_by("ts", key)
    return df.groupBy(*by).agg(at.alias("ts"), aggregate(name, df).alias("value")).where(F.col("value").isNotNull()).select(*by, "ts", "value")


class Spooled(Sequence):
    """A sequence of decoded values kept as bytes in a temporary file; only what is asked for is decoded."""

    def __init__(self, decode):
        self.decode, self.ends = decode, array("Q", [0])
        self.file = tempfile.SpooledTemporaryFile(max_size=8 << 20)

    def add(self, values) -> None:
        for v in values:
            self.ends.append(self.ends[-1] + self.file.write(bytes(v)))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(len(self)))]
        i = range(len(self))[i]
        self.file.seek(self.ends[i])
        return self.decode(self.file.read(self.ends[i + 1] - self.ends[i]))

    def __iter__(self):
        for at in range(0, len(self), 4096):
            ends = self.ends[at : at + 4097]
            self.file.seek(ends[0])
            block = self.file.read(ends[-1] - ends[0])
            for a, z in zip(ends, ends[1:]):
                yield self.decode(block[a - ends[0] : z - ends[0]])


def custom(df: DataFrame, decode, combine, encode, *, interval: int | None = None, origin: int = 0, by: tuple[str, ...] = ("metric", "labels")) -> DataFrame:
    """A user's aggregate over BINARY values: combine a sequence of decoded values in time order, encode.

    A group is streamed in Arrow batches to a file of its task, and decoded as ``combine`` reads it.
    """
    if df.schema["value"].dataType.simpleString() != "binary":
        raise UnsupportedAggregation("a custom aggregation takes binary values")
    ship(df.sparkSession)
    if interval is not None:
        df = df.withColumn("_b", bucket_start(F.col("ts"), interval, origin))
    keys = [*by, *(["_b"] if interval is not None else [])]
    rows = df.select(*keys, "ts", "seq", "value")
    at = "_b" if interval is not None else "ts"
    schema = rows.select(*by, F.col(at).alias("ts"), "value").schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = Spooled(decode)
        last = None
        for batch in batches:
            if batch.num_rows:
                values.add(batch.column("value").to_pylist())
                last = batch.slice(batch.num_rows - 1)
        out = pa.array([encode(combine(values))], last.column("value").type)
        yield pa.RecordBatch.from_arrays([*[last.column(k) for k in by], last.column(at), out], names=[*by, "ts", "value"])

    # sorted by time within keys; grouping needs no order of its own then
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "ts", "seq")
    return rows.groupBy(*keys).applyInArrow(each, schema)
