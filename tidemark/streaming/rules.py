"""Recording and alerting rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EvalError, InvalidRequest
from ..model import LABELS, set_label
from ..plans.compiler import Engine

# Fixed values.
MAX_ROWS = 10_000
STATE = f"rule string, metric string, labels {LABELS}, active_since long, firing boolean, value double"


@dataclass(frozen=True)
class Recording:
    record: str
    expr: str
    labels: dict[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Alert:
    alert: str
    expr: str
    for_: int = 0
    labels: dict[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Group:
    name: str
    interval: int
    rules: tuple
    labels: dict[str, str] = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if self.interval <= 0:
            raise InvalidRequest("a group's interval must be positive")
        for rule in self.rules:
            if any(v == "" for v in (self.labels | rule.labels).values()):
                raise InvalidRequest("empty label values are not allowed")

    def aligned(self, now: int) -> int:
        return now - now % self.interval


def record(engine: Engine, group: Group, rule: Recording, at: int) -> DataFrame:
    """(metric, labels, ts, value) to append: a rule's labels over the group's over the sample's."""
    out = engine.instant(rule.expr, at)
    if "text" in out.columns:
        raise EvalError("a recording rule gives a scalar or an instant vector")
    labels = F.col("labels")
    for n, v in (group.labels | rule.labels).items():
        labels = set_label(labels, n, F.lit(v))
    rows = out.select(F.lit(rule.record).alias("metric"), labels.alias("labels"), F.lit(at).cast("long").alias("ts"), "value")
    if rows.limit(MAX_ROWS + 1).count() > MAX_ROWS:
        raise EvalError(f"a rule makes at most {MAX_ROWS} rows")
    return rows


def alert(engine: Engine, group: Group, rule: Alert, at: int, state: DataFrame) -> DataFrame:
    """The rule's instances after evaluation at ``at``; ``state`` holds those before.

    An instance keeps the time it became active and fires once that is ``for_``
    ago; one that is gone is dropped.
    """
    out = engine.instant(rule.expr, at)
    labels = F.col("labels")
    for n, v in (group.labels | rule.labels | {"alertname": rule.alert}).items():
        labels = set_label(labels, n, F.lit(v))
    now = out.select(F.lit(rule.alert).alias("rule"), "metric", labels.alias("labels"), "value")
    before = state.where(F.col("rule") == rule.alert).select("rule", "metric", "labels", F.col("active_since").alias("_since"))
    since = F.coalesce("_since", F.lit(at).cast("long"))
    joined = now.join(before, ["rule", "metric", "labels"], "left")
    return joined.select("rule", "metric", "labels", since.alias("active_since"), (since <= at - rule.for_).alias("firing"), "value")


def evaluate(engine: Engine, group: Group, now: int, state: DataFrame, last: int | None = None) -> tuple[list[DataFrame], DataFrame, int]:
    """Rows to append, the new alert state, and the aligned time; nothing new if ``last`` is that time.

    A rule that fails keeps its instances.
    """
    at = group.aligned(now)
    if last == at:
        return [], state, at
    rows: list[DataFrame] = []
    states: list[DataFrame] = []
    for rule in group.rules:
        if isinstance(rule, Recording):
            rows.append(record(engine, group, rule, at))
            continue
        try:
            states.append(alert(engine, group, rule, at, state))
        except EvalError:
            states.append(state.where(F.col("rule") == rule.alert))
    if not states:
        return rows, state, at
    out = states[0]
    for more in states[1:]:
        out = out.unionByName(more)
    return rows, out, at
