"""Samples from relational tables: the event log and dated order lines.

Labels are also kept as ``label_<name>`` columns, so a matcher is a filter of
the source's column and reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import labels_of

#: Event times are in milliseconds.
UNITS = 1000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return df.select("event_id", "event_type", F.col("user_id").cast("string").alias("user_id"), (micros - F.pmod(micros, F.lit(1000))).alias("us"), "value").withColumn("ts", (F.col("us") / 1000).cast("long"))


def _samples(df: DataFrame, metric: str, *names: str) -> DataFrame:
    return df.select(
        F.lit(metric).alias("metric"),
        labels_of(**{n: n for n in names}).alias("labels"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").cast("double").alias("value"),
        F.lit(False).alias("is_stale"),
        *[F.col(n).alias(f"label_{n}") for n in names],
    )


def events_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge ``events_value{event_type, user_id}``."""
    return _samples(_events(spark, sf_dir), "events_value", "event_type", "user_id")


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge ``events_value{event_type}``."""
    return _samples(_events(spark, sf_dir), "events_value", "event_type")


def events_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter ``events_total{event_type}``: the running number of events of a type.

    Running counts are made from hourly totals and a count within the hour, so
    no task orders a whole type's events.
    """
    df = _events(spark, sf_dir).withColumn("hour", F.col("us") - F.pmod(F.col("us"), F.lit(3_600_000_000)))
    hours = df.groupBy("event_type", "hour").count()
    before = hours.withColumn("before", F.sum("count").over(Window.partitionBy("event_type").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    own = F.count(F.lit(1)).over(Window.partitionBy("event_type", "hour").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("own", own).join(before, ["event_type", "hour"]).withColumn("value", F.coalesce("before", F.lit(0)) + F.col("own"))
    return _samples(df, "events_total", "event_type")


def lineitem_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge ``lineitem_quantity{l_returnflag, l_linestatus}`` by ship day, many points a day."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    df = df.select("l_returnflag", "l_linestatus", (day * 86_400_000).alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), F.col("l_quantity").alias("value"))
    return _samples(df, "lineitem_quantity", "l_returnflag", "l_linestatus")
