"""Continuous rollups: incremental batches, reads that use them, and a streaming form.

A store keeps one Parquet folder a policy and generation. A run adds the
closed buckets after each series' checkpoint (its last materialized bucket);
late data or a delete before a checkpoint starts a new generation, and readers
see the old one until the new is complete.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..model import label
from ..operators import aggregations as A
from ..operators.select import series, within


@dataclass(frozen=True)
class Policy:
    id: str
    metric: str
    interval: int
    aggregation: str
    origin: int = 0
    match_labels: tuple[tuple[str, str], ...] = field(default=())

    def source(self, samples: DataFrame) -> DataFrame:
        out = samples.where(F.col("metric") == self.metric)
        for n, v in self.match_labels:
            out = out.where(label(F.col("labels"), n) == v)
        return out

    def covers(self, metric: str, labels: dict[str, str]) -> bool:
        return metric == self.metric and all(labels.get(n) == v for n, v in self.match_labels)


def validate(policies: list[Policy]) -> None:
    seen: set[str] = set()
    for p in policies:
        if not p.id or p.id in seen:
            raise InvalidRequest(f"policy ids must be unique and not empty: {p.id!r}")
        if p.interval <= 0:
            raise InvalidRequest(f"policy {p.id}: the interval must be positive")
        if p.aggregation not in A.AGGREGATIONS:
            raise InvalidRequest(f"policy {p.id}: unknown aggregation {p.aggregation!r}")
        if p.metric.startswith("__"):
            raise InvalidRequest(f"policy {p.id}: internal metric")
        seen.add(p.id)


class Store:
    """Rollups under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generation(self, policy: Policy) -> int:
        p, fs = self._fs(f"{self.path}/{policy.id}/current")
        if not fs.exists(p):
            return 0
        rows = self.spark.read.text(str(p)).collect()
        return json.loads(rows[0][0])["generation"]

    def _publish(self, policy: Policy, generation: int) -> None:
        p, fs = self._fs(f"{self.path}/{policy.id}/current")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"generation": generation}).encode()))
        out.close()

    def read(self, policy: Policy, generation: int | None = None) -> DataFrame | None:
        """(metric, labels, ts, value) of the materialized buckets."""
        g = self.generation(policy) if generation is None else generation
        p, fs = self._fs(f"{self.path}/{policy.id}/g{g}")
        return self.spark.read.parquet(str(p)) if fs.exists(p) else None

    def run(self, samples: DataFrame, policy: Policy, generation: int | None = None) -> DataFrame:
        """Adds the closed buckets each series lacks; returns them. The bucket of a series' last point is open."""
        g = self.generation(policy) if generation is None else generation
        source = policy.source(samples)
        done = self.read(policy, g)
        bucket = A.bucket_start(F.col("ts"), policy.interval, policy.origin)
        bounds = source.groupBy("metric", "labels").agg(F.max(bucket).alias("_open"))
        if done is not None:
            last = done.groupBy("metric", "labels").agg(F.max("ts").alias("_done"))
            bounds = bounds.join(last, ["metric", "labels"], "left")
        else:
            bounds = bounds.withColumn("_done", F.lit(None).cast("long"))
        fresh = source.join(bounds, ["metric", "labels"]).where((bucket < F.col("_open")) & (F.col("_done").isNull() | (bucket > F.col("_done"))))
        out = A.downsample(fresh, policy.interval, policy.aggregation, origin=policy.origin)
        out.write.mode("append").parquet(f"{self.path}/{policy.id}/g{g}")
        if generation is None:
            self._publish(policy, g)
        return out

    def rebuild(self, samples: DataFrame, policy: Policy) -> int:
        """A new generation from the samples as they are, published when complete."""
        g = self.generation(policy) + 1
        p, fs = self._fs(f"{self.path}/{policy.id}/g{g}")
        fs.delete(p, True)
        self.run(samples, policy, g)
        self._publish(policy, g)
        return g

    def is_late(self, batch: DataFrame, policy: Policy) -> bool:
        """Whether a batch holds points before a checkpoint of a series."""
        done = self.read(policy)
        if done is None:
            return False
        last = done.groupBy("metric", "labels").agg(F.max("ts").alias("_done"))
        late = policy.source(batch).join(last, ["metric", "labels"]).where(F.col("ts") < F.col("_done") + policy.interval)
        return late.limit(1).count() > 0

    def downsample(self, samples: DataFrame, policies: list[Policy], metric: str, labels: dict[str, str], start: int, end: int, interval: int, aggregation: str) -> tuple[DataFrame, str | None]:
        """(ts, value) and the policy used: its buckets up to the checkpoint, the rest from raw points.

        Fits are policies with this interval and aggregation whose buckets start
        at ``start``; of these the one with most match labels, then the latest
        checkpoint, then the largest id.
        """
        best: tuple | None = None
        for p in policies:
            if p.covers(metric, labels) and p.interval == interval and p.aggregation == aggregation and (start - p.origin) % interval == 0:
                done = self.read(p)
                last = series(done, metric, labels).agg(F.max("ts")).first()[0] if done is not None else None
                if last is not None and last + interval > start:
                    rank = (len(p.match_labels), last, p.id)
                    best = max(best, (rank, p, done)) if best and best[0] != rank else best or (rank, p, done)
        raw = series(samples, metric, labels)
        if best is None:
            return A.downsample(within(raw, start, end), interval, aggregation, origin=start).select("ts", "value").orderBy("ts"), None
        (_, last, _), p, done = best
        upto = min(last + interval, start + (end - start) // interval * interval)
        head = series(done, metric, labels).where((F.col("ts") >= start) & (F.col("ts") < upto)).select("ts", "value")
        if upto >= end:
            return head.orderBy("ts"), p.id
        tail = A.downsample(within(raw, max(start, upto), end), interval, aggregation, origin=start).select("ts", "value")
        return head.unionByName(tail).orderBy("ts"), p.id


def stream(samples: DataFrame, policy: Policy, *, units: int = 1000, delay: str = "15 minutes") -> DataFrame:
    """The rollup of a streaming samples frame: closed buckets, once the watermark has passed them.

    For use with ``outputMode("append")``; later points are dropped by the
    watermark, where the batch form rebuilds.
    """
    at = F.timestamp_micros((F.col("ts") * (1_000_000 / units)).cast("long"))
    width = f"{policy.interval * 1_000_000 // units} microseconds"
    source = policy.source(samples).withColumn("_at", at).withWatermark("_at", delay)
    source = source.withColumn("seq", F.col("seq") if "seq" in samples.columns else F.lit(0))
    grouped = source.groupBy("metric", "labels", F.window("_at", width, startTime=f"{policy.origin * 1_000_000 // units % max(1, policy.interval * 1_000_000 // units)} microseconds").alias("w"))
    out = grouped.agg(A.aggregate(policy.aggregation, samples).alias("value"))
    return out.select("metric", "labels", (F.unix_micros("w.start") / (1_000_000 / units)).cast("long").alias("ts"), "value")
