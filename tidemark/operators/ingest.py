"""A samples table that is written to: atomic batches, retention, deletes, tiers and the rollups that follow from it.

Batches are Parquet folders; numbered manifests name those that count, by tier,
and the last one holds. A manifest appears by one rename, so a reader sees a
batch whole or not at all, and of two writers at once one fails and may try
again. A late batch or a delete rebuilds the rollups it falls into before the
call returns.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..model import COLUMNS, finish, value_checks
from ..streaming.rollups import Policy, Store
from . import catalog

TIERS = ("hot", "warm", "cold")


@dataclass(frozen=True)
class Inserted:
    """What an insert did: rows written, and how durable they are when it returns."""

    rows: int
    acknowledged: str = "durable"


class SampleTable:
    """Samples under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, *, rollups: Store | None = None, policies: tuple[Policy, ...] = (), retention: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.rollups, self.policies, self.retention = rollups, policies, retention

    # manifest

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        p, fs = self._fs(f"{self.path}/manifests")
        numbers = [int(f.getPath().getName().split(".")[0]) for f in (fs.listStatus(p) if fs.exists(p) else []) if f.getPath().getName().endswith(".json")]
        if not numbers:
            return {"number": 0, "hot": [], "warm": [], "cold": [], "tombstones": None}
        return json.loads(self.spark.read.text(f"{p}/{max(numbers)}.json").first()[0])

    def _publish(self, manifest: dict) -> None:
        number = manifest["number"] + 1
        new, fs = self._fs(f"{self.path}/manifests/{uuid.uuid4().hex}.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(manifest | {"number": number}).encode()))
        out.close()
        to, _ = self._fs(f"{self.path}/manifests/{number}.json")
        if fs.exists(to) or not fs.rename(new, to):
            fs.delete(new, False)
            raise InvalidRequest("another writer was first")

    def _write(self, df: DataFrame) -> str:
        name = f"batch-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, names: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in names]) if names else None

    # writing

    def insert_rows(self, batch: DataFrame, *, now: int | None = None) -> Inserted:
        """Appends a batch of samples, all of it or, with a row that is not allowed, nothing.

        ``now`` and the table's retention bound how old a row may be. Columns
        that a source left out are filled.
        """
        rows = finish(batch).select(*COLUMNS)
        reason = value_checks(rows)
        if self.retention is not None and now is not None:
            reason = F.coalesce(reason, F.when(F.col("ts") < now - self.retention, F.lit("older than the retention")))
        # written once and then looked at, so a batch is computed once; it counts from the publishing on
        name = self._write(rows)
        staged = self._read([name])
        bad = staged.select(reason.alias("r")).where("r is not null").limit(1).collect()
        if bad:
            p, fs = self._fs(f"{self.path}/{name}")
            fs.delete(p, True)
            raise InvalidRequest(f"rejected: {bad[0].r}")
        late = [p for p in self.policies if self.rollups is not None and self.rollups.is_late(staged, p)]
        manifest = self.manifest()
        manifest["hot"].append(name)
        self._publish(manifest)
        for policy in late:
            self.rollups.rebuild(self.read(), policy)
        return Inserted(staged.count())

    def delete_series(self, matched: DataFrame, start: int, end: int) -> tuple[int, int]:
        """Hides [start, end) of the (metric, labels) given; returns how many matched and changed, and rebuilds rollups."""
        stones, found, changed = catalog.tombstone(self.tombstones(), matched, start, end)
        manifest = self.manifest()
        manifest["tombstones"] = self._write(stones)
        self._publish(manifest)
        if changed and self.rollups is not None:
            for policy in self.policies:
                done = self.rollups.read(policy)
                if done is not None and done.where((F.col("ts") < end) & (F.col("ts") + policy.interval > start)).limit(1).count():
                    self.rollups.rebuild(self.read(), policy)
        return found, changed

    def age(self, *, hot_from: int, warm_from: int) -> None:
        """Moves rows from before ``hot_from`` to the warm tier, and from before ``warm_from`` to the cold one."""
        manifest = self.manifest()
        every = self._read([n for t in TIERS for n in manifest[t]])
        if every is None:
            return
        ts = F.col("ts")
        parts = {"hot": ts >= hot_from, "warm": (ts < hot_from) & (ts >= warm_from), "cold": (ts < hot_from) & (ts < warm_from)}
        self._publish(manifest | {t: [self._write(every.where(c))] for t, c in parts.items()})

    # reading

    def tombstones(self) -> DataFrame:
        name = self.manifest()["tombstones"]
        return self._read([name]) if name else self.spark.createDataFrame([], catalog.EMPTY_TOMBSTONES)

    def read(self, start: int | None = None, *, hot_from: int | None = None, warm_from: int | None = None) -> DataFrame:
        """The samples that are not deleted; with the tiers' bounds, of the tiers that a read from ``start`` touches."""
        manifest = self.manifest()
        wanted = TIERS if hot_from is None or warm_from is None else catalog.tiers(start, hot_from, warm_from)
        df = self._read([n for t in wanted for n in manifest[t]])
        if df is None:
            empty = self.spark.createDataFrame([], "metric string, labels array<struct<name:string,value:string>>, ts long, value double")
            return finish(empty).select(*COLUMNS)
        df = df if start is None else df.where(F.col("ts") >= start)
        return catalog.without_deleted(df, self.tombstones()) if manifest["tombstones"] else df
