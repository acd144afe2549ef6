"""Relative gauges on a stream: each series' running value is kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hashes import series_key


def gauges(events: DataFrame) -> DataFrame:
    """Streaming (key, metric, ts, value) of gauge events (metric, labels, ts, value, relative, seq)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else 0.0
        for df in frames:
            df = df.sort_values(["ts", "seq"])
            out = []
            for v, relative in zip(df["value"], df["relative"], strict=True):
                now = now + v if relative else v
                out.append(now)
            state.update((now,))
            yield pd.DataFrame({"key": df["key"], "metric": df["metric"], "ts": df["ts"], "value": out})

    keyed = events.select(series_key(F.col("metric"), F.col("labels")).alias("key"), "metric", "ts", "value", "relative", "seq")
    return keyed.groupBy("key").applyInPandasWithState(run, "key string, metric string, ts long, value double", "value double", "append", GroupStateTimeout.NoTimeout)
