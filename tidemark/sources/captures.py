"""Migration: recorded request bodies, backfill into a table, verification and cutover.

A capture is a JSON file, an array of ``{received_at_ms, query_params, body}``.
Bodies are text of many lines; a line without a time of its own has the time
it was received.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..model import finish
from ..operators.ingest import SampleTable
from ..operators.select import within
from . import text

CAPTURE = "received_at_ms long, query_params struct<db:string,precision:string>, body string"


def read_capture(spark: SparkSession, path: str, form: str, *, units: int = 1000) -> DataFrame:
    """Samples (metric, labels, ts, value, seq) of a capture of ``measurement``, ``graphite`` or ``statsd`` bodies.

    Null bodies and empty lines have no rows; a bad line fails the read.
    """
    requests = spark.read.schema(CAPTURE).option("multiLine", True).json(path).withColumn("_r", F.monotonically_increasing_id())
    lines = requests.select((F.col("received_at_ms") * units / 1000).cast("long").alias("ts"), F.coalesce("query_params.precision", F.lit("ns")).alias("precision"), "_r", F.posexplode(F.split("body", "\n", -1)).alias("pos", "value"))
    lines = lines.where(F.trim("value") != "").withColumn("seq", F.col("_r") * (1 << 20) + F.col("pos"))
    if form == "statsd":
        return text.statsd(lines).select("metric", "labels", "ts", "value", "seq")
    if form == "graphite":
        return text.read(lines, form, ts_col="ts", units=units)
    if form != "measurement":
        raise InvalidRequest(f"no captures of {form!r}")
    found = [r.precision for r in lines.select("precision").distinct().collect()]
    parts = [text.read(lines.where(F.col("precision") == p), form, ts_col="ts", precision=p, units=units) for p in sorted(found)]
    out = parts[0] if parts else text.read(lines, form, ts_col="ts", units=units)
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@dataclass
class Migration:
    """Moves samples of another store into ``table``: backfill, then verify, then cut over."""

    source: DataFrame
    table: SampleTable

    def backfill(self, start: int, end: int, window: int) -> int:
        """Inserts [start, end) a window at a time, each a batch of its own; returns the batches that had rows.

        What is in the table already (of a backfill that was broken off) is
        not inserted again.
        """
        done = 0
        for at in range(start, end, window):
            part = within(finish(self.source), at, min(at + window, end))
            held = self.table.read().where((F.col("ts") >= at) & (F.col("ts") < min(at + window, end))).select("metric", "labels", "ts").distinct()
            part = part.join(held, ["metric", "labels", "ts"], "left_anti")
            if part.limit(1).count():
                self.table.insert_rows(part)
                done += 1
        return done

    def differences(self, start: int, end: int) -> DataFrame:
        """Rows (metric, labels, ts, left, right) of [start, end) that differ or are missing on a side."""
        return text.compare(within(self.source, start, end), within(self.table.read(), start, end))

    def cutover(self, start: int, end: int) -> SampleTable:
        """The table, if it holds what the source does; else an error, and reads stay with the source."""
        found = self.differences(start, end).limit(1).collect()
        if found:
            raise InvalidRequest(f"not the same at {found[0].metric} {found[0].ts}: {found[0].left} and {found[0].right}")
        return self.table
