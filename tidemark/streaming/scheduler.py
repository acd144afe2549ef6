"""Rule groups on a schedule: due groups are evaluated, rows appended, alert states kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.ingest import SampleTable
from ..plans.compiler import Engine
from . import rules


class Scheduler:
    """Evaluates ``groups`` over ``table`` and writes recorded rows back to it.

    ``tick`` may be called at any pace, also from ``foreachBatch``: a group runs
    once for each of its interval's times that a tick falls into.
    """

    def __init__(self, table: SampleTable, groups: tuple[rules.Group, ...], path: str, *, lookback_ms: int = 300_000, units: int = 1000):
        self.table, self.groups, self.path = table, groups, path.rstrip("/")
        self.lookback_ms, self.units = lookback_ms, units
        self.last: dict[str, int] = {}

    def state(self, group: rules.Group) -> DataFrame:
        """The group's alert instances after its last run."""
        spark, at = self.table.spark, self.last.get(group.name)
        return spark.createDataFrame([], rules.STATE) if at is None else spark.read.parquet(f"{self.path}/{group.name}-{at}")

    def tick(self, now: int) -> int:
        """Runs the groups that are due; returns the rows recorded. A group's rows are one batch, read by the next group."""
        recorded = 0
        for group in self.groups:
            if self.last.get(group.name) == group.aligned(now):
                continue
            engine = Engine(self.table.read(), lookback_ms=self.lookback_ms, units=self.units)
            rows, state, at = rules.evaluate(engine, group, now, self.state(group), self.last.get(group.name))
            state.write.mode("overwrite").parquet(f"{self.path}/{group.name}-{at}")
            for part in rows[1:]:
                rows[0] = rows[0].unionByName(part)
            if rows and rows[0].limit(1).count():
                recorded += self.table.insert_rows(rows[0]).rows
            self.last[group.name] = at
        return recorded
