"""The samples frame: one row a point of a labelled series.

Columns: ``metric``, ``labels`` (array of (name, value) sorted by name),
``ts`` (whole units), ``seq`` (ingest order, breaks ties of ``ts``), ``value``
(double view), ``is_stale``; optionally ``hist`` (native histogram) and
``label_<name>`` columns that repeat a label so that its matchers reach the
scan as plain filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = "array<struct<name:string,value:string>>"
SPANS = "array<struct<offset:int,length:bigint>>"
HIST = (
    "struct<count:double,sum:double,schema:int,zero_threshold:double,zero_count:double,"
    f"negative_spans:{SPANS},negative_counts:array<double>,positive_spans:{SPANS},positive_counts:array<double>,"
    "reset_hint:string,custom_values:array<double>>"
)
COLUMNS = ("metric", "labels", "ts", "seq", "value", "is_stale")

#: Limits on names and values, in bytes.
MAX_NAME, MAX_VALUE, MAX_METRIC = 256, 16 * 1024, 65_535


def labels_of(**columns: Column | str) -> Column:
    """A sorted label array; a null value leaves its label out."""
    pairs = [F.when(c.isNotNull(), F.struct(F.lit(n).alias("name"), c.cast("string").alias("value"))) for n, c in ((n, F.col(c) if isinstance(c, str) else c) for n, c in sorted(columns.items()))]
    return F.filter(F.array(*pairs), lambda x: x.isNotNull()).cast(LABELS) if pairs else F.array().cast(LABELS)


def label(labels: Column, name: str) -> Column:
    """A label's value, '' where it is missing."""
    return F.coalesce(F.get(F.filter(labels, lambda x: x["name"] == name), F.lit(0))["value"], F.lit(""))


def has_label(labels: Column, name: str) -> Column:
    return F.exists(labels, lambda x: x["name"] == name)


def keep_labels(labels: Column, names: tuple[str, ...]) -> Column:
    return F.filter(labels, lambda x: x["name"].isin(list(names))) if names else F.array().cast(LABELS)


def drop_labels(labels: Column, names: tuple[str, ...]) -> Column:
    return F.filter(labels, lambda x: ~x["name"].isin(list(names))) if names else labels


def set_label(labels: Column, name: str, value: Column) -> Column:
    """Sets, or removes where the value is empty or null."""
    one = F.array(F.struct(F.lit(name).alias("name"), value.alias("value")))
    rest = drop_labels(labels, (name,))
    return F.when(F.coalesce(value, F.lit("")) == "", rest).otherwise(F.array_sort(F.concat(rest, one)))


def finish(df: DataFrame) -> DataFrame:
    """Fills the columns a source left out."""
    out = df
    if "seq" not in df.columns:
        out = out.withColumn("seq", F.monotonically_increasing_id())
    if "is_stale" not in df.columns:
        out = out.withColumn("is_stale", F.lit(False))
    return out


def value_checks(df: DataFrame) -> Column:
    """A reason for each row that ingest rejects, else null."""
    names = F.col("labels.name")
    return (
        F.when(F.coalesce(F.col("metric"), F.lit("")) == "", F.lit("empty metric"))
        .when(F.octet_length("metric") > MAX_METRIC, F.lit("metric too long"))
        .when(F.exists(names, lambda n: n == ""), F.lit("empty label name"))
        .when(F.size(F.array_distinct(names)) < F.size(names), F.lit("duplicate label"))
        .when(F.exists(names, lambda n: F.octet_length(n) > MAX_NAME), F.lit("label name too long"))
        .when(F.exists(F.col("labels.value"), lambda v: F.octet_length(v) > MAX_VALUE), F.lit("label value too long"))
    )
