"""More registered queries with SQL: sources and sinks, native histograms, info, scans, metadata, comparisons.

Wire formats are checked by round trips: rows of the event table are written
in the format and read back, and the SQL reads the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import InvalidRequest
from .model import HIST, finish, label, labels_of
from .operators import aggregations as A
from .operators import catalog, select
from .operators.ingest import SampleTable
from .plans.compiler import Engine
from .registry import _LATEST, CLICK, DAY, END, EV, FIRST, GAUGE, HI, HOUR, LINES, LO, ORACLES, R6, SIX, START, STEPS, USERS, WIN, ARR, _extrapolated, add, flat, instant, ranged
from .session import scratch
from .sources import captures, tables, text, wire
from .streaming import rollups, rules
from .streaming.scheduler import Scheduler

BOTH = ("event_type", "user_id")
_TYPED = f"WITH {EV} SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, t AS ts, {R6('value')} AS value FROM ev"


def _latest(sql: str) -> str:
    return _LATEST + sql


# Text sources.

def _lines(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    """A line for each event; ``line`` is an expression over event_id, event_type, user_id, ts (ms), v (the value's text)."""
    df = tables._events(spark, sf_dir).withColumn("v", F.col("value").cast("string"))
    return df.select(F.expr(line).alias("value"), F.col("ts"), F.col("event_id").alias("seq"))


def _text(form: str, line: str, *names: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = text.read(_lines(spark, sf_dir, line), form, **options)
        return got.select("metric", *[label(F.col("labels"), n).alias(n) for n in names], "ts", F.round("value", SIX).alias("value"))

    return run


_EXPOSED = """concat('events_value{event_type="', event_type, '",user_id="', user_id, '"} ', v, ' ', ts)"""
add("src_exposition", _text("exposition", _EXPOSED, *BOTH), _TYPED.replace("SELECT event_type", "SELECT 'events_value' AS metric, event_type"))
_MEASURED = "concat('events,event_type=', event_type, ',user_id=', user_id, ' value=', v, ',id=', event_id, 'i ', ts, '000000')"
add(
    "src_line_protocol",
    _text("measurement", _MEASURED, *BOTH),
    f"WITH {EV}, e AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, t, value, event_id FROM ev) SELECT 'events' AS metric, event_type, user_id, t AS ts, {R6('value')} AS value FROM e UNION ALL SELECT 'events_id', event_type, user_id, t, CAST(event_id AS DOUBLE) FROM e",
)
_GRAPHITE = "concat('events.value;event_type=', event_type, ';user_id=', user_id, ' ', v, ' ', ts div 1000)"
add("src_graphite", _text("graphite", _GRAPHITE, *BOTH), f"WITH {EV} SELECT 'events_value' AS metric, event_type, CAST(user_id AS VARCHAR) AS user_id, t // 1000 * 1000 AS ts, {R6('value')} AS value FROM ev")


def _ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables._events(spark, sf_dir)
    point = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    one = df.groupBy("event_type", "user_id").agg(point.alias("p"))
    metric = F.struct(F.lit("events_value").alias("__name__"), "event_type", "user_id").alias("metric")
    line = F.to_json(F.struct(metric, F.col("p.value").alias("values"), F.col("p.ts").alias("timestamps")))
    return flat(text.read(one.select(line.alias("value")), "ndjson"), *BOTH)


add("src_ndjson", _ndjson, _TYPED)


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = "concat('hits:', event_id % 5 + 1, '|c|@0.5|#event_type:', event_type)"
    return flat(text.statsd(_lines(spark, sf_dir, hit)), "event_type")


def _gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "concat('load:', if(event_id % 10 = 0, '', '+'), v, '|g|#event_type:', event_type)"
    return flat(text.statsd(_lines(spark, sf_dir, own)), "event_type")


add("src_statsd_counter", _counters, f"WITH {EV} SELECT event_type, t AS ts, CAST((event_id % 5 + 1) * 2 AS DOUBLE) AS value FROM ev")
add(
    "src_statsd_gauge",
    _gauges,
    f"WITH {EV}, e AS (SELECT *, sum(CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY t, event_id) AS era FROM ev) SELECT event_type, t AS ts, round(sum(value) OVER (PARTITION BY event_type, era ORDER BY t, event_id), {SIX}) AS value FROM e",
)
_MIGRATED = "WITH ev AS (SELECT event_type, event_id, epoch_us(ts) // 1000 AS t, value FROM events), "


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between the hourly sums of all events and of those whose id is not divisible by 100."""
    hourly = lambda df: A.downsample(df, HOUR, "sum", origin=0)
    df = GAUGE(spark, sf_dir)
    found = text.compare(hourly(df), hourly(df.where("seq % 100 != 0")))
    return found.select(label(F.col("labels"), "event_type").alias("event_type"), "ts", F.round("left", SIX).alias("l"), F.round("right", SIX).alias("r"))


add(
    "migration_compare",
    _compared,
    _MIGRATED
    + f"a AS (SELECT event_type, t // {HOUR} * {HOUR} AS ts, sum(value) AS l FROM ev GROUP BY ALL), b AS (SELECT event_type, t // {HOUR} * {HOUR} AS ts, sum(value) AS r FROM ev WHERE event_id % 100 <> 0 GROUP BY ALL), "
    + f"c AS (SELECT DISTINCT event_type, t // {HOUR} * {HOUR} AS ts FROM ev WHERE event_id % 100 = 0) SELECT event_type, ts, {R6('l')} AS l, {R6('r')} AS r FROM c JOIN a USING (event_type, ts) LEFT JOIN b USING (event_type, ts)",
)

# Wire sources.

add("src_remote_write", lambda s, d: flat(wire.read_remote_write(wire.write_bodies(USERS(s, d))), *BOTH), _TYPED)
add("src_otlp", lambda s, d: flat(wire.read_otlp(wire.otlp_bodies(USERS(s, d).withColumn("labels", labels_of(type="label_event_type", user="label_user_id")))), "type", "user", "otel_metric_kind"), _TYPED.replace("SELECT event_type, CAST(user_id AS VARCHAR) AS user_id,", "SELECT event_type AS type, CAST(user_id AS VARCHAR) AS user, 'gauge' AS otel_metric_kind,"))


def _remote_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = wire.remote_read(USERS(spark, sf_dir), (select.Matcher("event_type", "=", "click"), select.Matcher("__name__", "=", "events_value")), LO, HI)
    rows = got.select("labels", F.explode("samples").alias("s")).select("labels", F.col("s.ts").alias("ts"), F.col("s.value").alias("value"))
    return flat(rows, "__name__", *BOTH)


add("src_remote_read", _remote_read, f"WITH {EV} SELECT 'events_value' AS __name__, event_type, CAST(user_id AS VARCHAR) AS user_id, t AS ts, {R6('value')} AS value FROM ev WHERE event_type = 'click' AND t >= {LO} AND t <= {HI}")

# Exemplars and metadata.


def _exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = """concat('events_total{event_type="', event_type, '"} 1 ', ts, ' # {trace_id="', event_id, '"} ', v, ' ', ts)"""
    read = text.read_exemplars(_lines(spark, sf_dir, line))
    return read.withColumn("seq", label(F.col("exemplar_labels"), "trace_id").cast("long"))


def _exemplar(df: DataFrame) -> DataFrame:
    return df.select(label(F.col("labels"), "event_type").alias("event_type"), label(F.col("exemplar_labels"), "trace_id").alias("trace_id"), "ts", F.round("value", SIX).alias("value"))


_EX = f"WITH {EV}, n AS (SELECT event_type, t AS ts, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM ev GROUP BY 1, 2), "
add("exemplars_read", lambda s, d: _exemplar(_exemplars(s, d)), f"WITH {EV} SELECT event_type, CAST(event_id AS VARCHAR) AS trace_id, t AS ts, {R6('value')} AS value FROM ev")
add(
    "exemplars_kept",
    lambda s, d: _exemplar(catalog.keep_exemplars(_exemplars(s, d), per_series=20, in_all=70)),
    _EX + f"k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM n) SELECT event_type, CAST(event_id AS VARCHAR) AS trace_id, ts, {R6('value')} AS value FROM (SELECT * FROM k WHERE r <= 20 ORDER BY ts DESC, event_type LIMIT 70)",
)
add(
    "exemplars_query",
    lambda s, d: _exemplar(catalog.query_exemplars(catalog.keep_exemplars(_exemplars(s, d), per_series=50, in_all=200), Engine(GAUGE(s, d)), 'rate(events_total{event_type=~"click|view"}[5m])', END - DAY, END, limit=30)),
    _EX
    + f"k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM n), s AS (SELECT * FROM k WHERE r <= 50 ORDER BY ts DESC, event_type LIMIT 200) SELECT event_type, CAST(event_id AS VARCHAR) AS trace_id, ts, {R6('value')} AS value FROM s WHERE event_type IN ('click', 'view') AND ts BETWEEN {END - DAY} AND {END} ORDER BY event_type, ts LIMIT 30",
)


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables._events(spark, sf_dir)
    rows = df.select(F.lit(catalog.DEFAULT_TENANT).alias("tenant"), F.col("event_type").alias("family"), F.when(F.col("event_id") % 2 == 0, "gauge").otherwise("counter").alias("type"), F.concat(F.lit("help "), F.col("event_id").cast("string")).alias("help"), F.lit("s").alias("unit"), F.col("event_id").alias("updated"))
    return catalog.metadata(rows.unionByName(rows.withColumn("tenant", F.lit("other")).withColumn("help", F.lit("no"))), limit=4)


add("metadata", _metadata, "SELECT event_type AS family, CASE WHEN max(event_id) % 2 = 0 THEN 'gauge' ELSE 'counter' END AS type, 'help ' || max(event_id) AS help, 's' AS unit FROM events GROUP BY 1 ORDER BY 1 LIMIT 4")

# Native histograms: of a day's values by type; buckets (2^i, 2^(i+1)] for i in 0..9, zero bucket up to 1.

EDGES = 10


def _native(spark: SparkSession, sf_dir: str, *, running: bool = False, custom: bool = False) -> DataFrame:
    df = GAUGE(spark, sf_dir).withColumn("ts", F.col("ts") - F.pmod("ts", F.lit(DAY)) + DAY)
    counts = [F.sum(F.when((F.col("value") > float(2**i)) & ((F.col("value") <= float(2 ** (i + 1))) | F.lit(i == EDGES - 1)), 1.0).otherwise(0.0)).alias(f"c{i}") for i in range(EDGES)]
    wide = df.groupBy("label_event_type", "ts").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("s"), F.sum(F.when(F.col("value") <= 1, 1.0).otherwise(0.0)).alias("z"), *counts)
    if running:
        w = Window.partitionBy("label_event_type").orderBy("ts")
        wide = wide.select("label_event_type", "ts", *[F.sum(c).over(w).alias(c) for c in ("n", "s", "z", *(f"c{i}" for i in range(EDGES)))])
    none = F.array().cast("array<double>")
    spans = F.array(F.struct(F.lit(0).alias("offset"), F.lit(EDGES).cast("long").alias("length")))
    fields = {
        "count": F.col("n"), "sum": F.col("s"), "schema": F.lit(0), "zero_threshold": F.lit(1.0), "zero_count": F.col("z"), "negative_spans": F.array(), "negative_counts": none,
        "positive_spans": spans, "positive_counts": F.array(*[f"c{i}" for i in range(EDGES)]), "reset_hint": F.lit("No" if running else "Unknown"), "custom_values": F.array(F.lit(1.0)) if custom else none,
    }
    hist = F.struct(*[c.alias(k) for k, c in fields.items()]).cast(HIST)
    rows = wide.select(F.lit("events_native").alias("metric"), labels_of(event_type="label_event_type").alias("labels"), "ts", F.lit(float("nan")).alias("value"), hist.alias("hist"))
    return finish(rows)


_NH = f"WITH {EV}, h AS (SELECT event_type, t // {DAY} * {DAY} + {DAY} AS ts, value AS v FROM ev), g AS (SELECT event_type, ts, CAST(count(*) AS DOUBLE) AS n, sum(v) AS s FROM h GROUP BY ALL) "
_IN = f"WHERE ts >= {FIRST} AND ts <= {END - DAY}"
for _name, _sql in {"count": "n", "sum": "s", "avg": "s / n"}.items():
    add(f"native_histogram_{_name}", ranged(_native, f"histogram_{_name}(events_native)", "event_type"), _NH + f"SELECT event_type, ts, {R6(_sql)} AS value FROM g {_IN}")


def _native_quantile(by: str, phi: float) -> str:
    """Linear interpolation in the bucket that holds rank phi * n."""
    keys = f"{by}, ts" if by else "ts"
    return (
        f"WITH {EV}, h AS (SELECT event_type, t // {DAY} * {DAY} + {DAY} AS ts, value AS v FROM ev), "
        f"b AS (SELECT {keys}, CASE WHEN v <= 1 THEN -1 ELSE CAST(least(greatest(ceil(log2(v)) - 1, 0), {EDGES - 1}) AS INT) END AS i, count(*) AS n FROM h GROUP BY ALL), "
        f"c AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY i) AS upto, {phi} * sum(n) OVER (PARTITION BY {keys}) AS k FROM b), "
        f"x AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY i) AS r FROM c WHERE k <= upto) "
        f"SELECT {keys}, round(CASE WHEN i < 0 THEN -1.0 ELSE pow(2, i) END + CASE WHEN i < 0 THEN 2.0 ELSE pow(2, i) END * ((k - (upto - n)) / n), {SIX}) AS value FROM x WHERE r = 1 AND ts >= {FIRST} AND ts <= {END - DAY}"
    )


add("native_histogram_quantile", ranged(_native, "histogram_quantile(0.6, events_native)", "event_type"), _native_quantile("event_type", 0.6))
add("native_histogram_merged", ranged(_native, "histogram_quantile(0.9, sum(events_native))"), _native_quantile("", 0.9))
add("native_histogram_avg_of", ranged(_native, "histogram_count(avg(events_native))"), _NH + f"SELECT ts, round(avg(n), {SIX}) AS value FROM g {_IN} GROUP BY ts")
add("native_histogram_negated", ranged(_native, "histogram_sum(-events_native)", "event_type"), _NH + f"SELECT event_type, ts, round(-s, {SIX}) AS value FROM g {_IN}")
for _name in ("stddev", "stdvar", "fraction"):
    _args = "0, 10, " if _name == "fraction" else ""
    add(f"histogram_{_name}_of_floats", ranged(GAUGE, f"histogram_{_name}({_args}events_value)", "event_type"), f"WITH {EV} SELECT event_type, t AS ts, value FROM ev WHERE false")
add("native_histogram_custom_count", ranged(lambda s, d: _native(s, d, custom=True), "histogram_count(events_native)", "event_type"), _NH + f"SELECT event_type, ts, {R6('n')} AS value FROM g {_IN}")

# Operators and functions that had no counterpart so far.

for _op, _sql in {"==": "=", "!=": "<>", "<": "<", "<=": "<="}.items():
    _n = {"==": "eq", "!=": "ne", "<": "lt", "<=": "le"}[_op]
    add(f"bin_{_n}", instant(USERS, f"floor(events_value / 10) {_op} 2", *BOTH), _latest(f"SELECT event_type, user_id, ts, floor(v / 10) AS value FROM lv WHERE floor(v / 10) {_sql} 2"))
    add(f"bin_{_n}_bool", instant(USERS, f"2 {_op} bool floor(events_value / 10)", *BOTH), _latest(f"SELECT event_type, user_id, ts, CAST(2 {_sql} floor(v / 10) AS INT)::DOUBLE AS value FROM lv"))
add("bin_atan2", instant(USERS, "events_value atan2 7", *BOTH), _latest(f"SELECT event_type, user_id, ts, {R6('atan2(v, 7)')} AS value FROM lv"))
add("bin_pow", instant(USERS, "(events_value / 100) ^ 2.5", *BOTH), _latest(f"SELECT event_type, user_id, ts, {R6('pow(v / 100, 2.5)')} AS value FROM lv"))
for _f, (_q, _sql) in {
    "tan": ("tan(events_value / 1000)", "tan(v / 1000)"), "asin": ("asin(events_value / 100000)", "asin(v / 100000)"), "acos": ("acos(events_value / 100000)", "acos(v / 100000)"),
    "cosh": ("cosh(events_value / 1000)", "cosh(v / 1000)"), "acosh": ("acosh(events_value + 1)", "acosh(v + 1)"), "atanh": ("atanh(events_value / 100000)", "atanh(v / 100000)"),
}.items():
    add(f"math_{_f}", instant(USERS, _q, *BOTH), _latest(f"SELECT event_type, user_id, ts, {R6(_sql)} AS value FROM lv"))
_ALL = _latest(f"SELECT event_type, user_id, ts, {R6('v')} AS value FROM lv")


def _placed(query: str):
    """Rows with their place in the order of the result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = flat(Engine(USERS(spark, sf_dir), lookback_ms=DAY).instant(query, END), *BOTH)
        # a sorted result is a few partitions in order; ids follow them
        return out.withColumn("_id", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("_id"))).drop("_id")

    return run


add("sort_places", _placed("sort(events_value)"), _latest(f"SELECT event_type, user_id, ts, {R6('v')} AS value, CAST(row_number() OVER (ORDER BY v, event_type, user_id) AS INTEGER) AS place FROM lv"))
add("sort_desc_places", _placed("sort_desc(events_value)"), _latest(f"SELECT event_type, user_id, ts, {R6('v')} AS value, CAST(row_number() OVER (ORDER BY v DESC, event_type, user_id) AS INTEGER) AS place FROM lv"))
add("sort_by_label_desc", instant(USERS, 'sort_by_label_desc(events_value, "user_id")', *BOTH), _ALL)
for _where, _at in (("start", FIRST), ("end", END - DAY)):
    add(
        f"at_{_where}",
        ranged(GAUGE, f"events_value @ {_where}()", "event_type"),
        f"WITH {EV}, {STEPS}, p AS (SELECT event_type, arg_max(value, (t, -event_id)) AS v FROM ev WHERE t >= {_at} - 300000 AND t <= {_at} GROUP BY 1) SELECT event_type, s AS ts, {R6('v')} AS value FROM p, st",
    )
_SMOOTH = "list_reduce(list_prepend({'l': v[1], 'b': v[2] - v[1]}, list_transform(v[2:], lambda x: {'l': x, 'b': 0.0::DOUBLE})), lambda a, p: {'l': p.l * 0.5 + (a.l + a.b) * 0.5, 'b': (p.l * 0.5 + (a.l + a.b) * 0.5 - a.l) * 0.1 + a.b * 0.9})"
add("range_double_exponential_smoothing", ranged(GAUGE, "double_exponential_smoothing(events_value[6h], 0.5, 0.1)", "event_type"), f"WITH {EV}, {STEPS}, {WIN}, {ARR}, z AS (SELECT event_type, s, {_SMOOTH} AS f FROM a WHERE n > 1) SELECT event_type, s AS ts, round(f.l + f.b, {SIX}) AS value FROM z")


def _informed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = USERS(spark, sf_dir).withColumn("labels", labels_of(job="label_event_type", instance="label_user_id")).drop("label_event_type", "label_user_id")
    who = df.select("labels").distinct()
    instance = label(F.col("labels"), "instance")
    info = who.select(labels_of(job=label(F.col("labels"), "job"), instance=instance, region=F.concat(F.lit("r"), (instance.cast("long") % 3).cast("string")), team=F.when(instance.cast("long") % 2 == 0, "core")).alias("labels"))
    info = info.select(F.lit("target_info").alias("metric"), "labels", F.lit(END).cast("long").alias("ts"), F.lit(1 << 40).alias("seq"), F.lit(1.0).alias("value"), F.lit(False).alias("is_stale"))
    return df.select(info.columns).unionByName(info)


add(
    "info",
    instant(_informed, "info(events_value)", "job", "instance", "region", "team"),
    _latest(f"SELECT event_type AS job, user_id AS instance, 'r' || CAST(user_id AS BIGINT) % 3 AS region, CASE WHEN CAST(user_id AS BIGINT) % 2 = 0 THEN 'core' ELSE '' END AS team, ts, {R6('v')} AS value FROM lv"),
)
add("metricless_selector", instant(USERS, '{event_type="click",__name__=~"events_.*"}', *BOTH), _latest(f"SELECT event_type, user_id, ts, {R6('v')} AS value FROM lv WHERE event_type = 'click'"))


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides ``events_value{event_type, user_id}``, a series that has the event type alone: it hides the others."""
    both = USERS(spark, sf_dir)
    alone = both.where("label_event_type = 'click'").withColumn("labels", labels_of(event_type="label_event_type")).withColumn("label_user_id", F.lit(None).cast("string"))
    return both.unionByName(alone)


add("exact_series", instant(_exact, 'events_value{event_type="click"}', *BOTH), f"WITH {EV} SELECT 'click' AS event_type, '' AS user_id, max(t) AS ts, round(arg_max(value, (t, -event_id)), {SIX}) AS value FROM ev WHERE event_type = 'click' AND t >= {END} - {DAY} AND t <= {END}")
add("exact_series_among_many", instant(_exact, 'events_value{event_type="view"}', *BOTH), _latest(f"SELECT event_type, user_id, ts, {R6('v')} AS value FROM lv WHERE event_type = 'view'"))

# Select API: integers, user aggregates, scans, shards, writes.

_LI = "WITH li AS (SELECT l_returnflag, l_linestatus, epoch_ms(CAST(l_shipdate AS TIMESTAMP)) AS t, l_orderkey * 10 + l_linenumber AS o, CAST(l_quantity AS BIGINT) AS v FROM lineitem) "
_FLAGS = ("l_returnflag", "l_linestatus")
for _name, _sql in {"sum": "CAST(sum(v) AS BIGINT)", "min": "min(v)", "max": "max(v)", "range": "max(v) - min(v)", "last": "arg_max(v, (t, o))"}.items():
    add(
        f"downsample_{_name}_integers",
        lambda s, d, n=_name: A.downsample(LINES(s, d).withColumn("value", F.col("value").cast("long")), 30 * DAY, n, origin=0).select(*[label(F.col("labels"), x).alias(x) for x in _FLAGS], "ts", "value"),
        _LI + f"SELECT l_returnflag, l_linestatus, t // {30 * DAY} * {30 * DAY} AS ts, {_sql} AS value FROM li GROUP BY ALL",
    )


def _custom(spark: SparkSession, sf_dir: str, interval: int | None) -> DataFrame:
    """The sum of squares, as a user's aggregate over values kept as text."""
    df = GAUGE(spark, sf_dir).withColumn("value", F.col("value").cast("string").cast("binary"))
    out = A.custom(df, lambda b: float(b.decode()), lambda xs: sum(x * x for x in xs), lambda x: repr(x).encode(), interval=interval)
    return out.select(label(F.col("labels"), "event_type").alias("event_type"), "ts", F.round(F.col("value").cast("string").cast("double"), 1).alias("value"))


add("custom_aggregate_series", lambda s, d: _custom(s, d, None), f"WITH {EV} SELECT event_type, max(t) AS ts, round(sum(value * value), 1) AS value FROM ev GROUP BY 1")
add("custom_aggregate_buckets", lambda s, d: _custom(s, d, 5 * DAY), f"WITH {EV} SELECT event_type, t // {5 * DAY} * {5 * DAY} AS ts, round(sum(value * value), 1) AS value FROM ev GROUP BY ALL")
_PAGE = f"WITH {EV} SELECT event_type, t AS ts, {R6('value')} AS value FROM ev WHERE t >= {LO} AND t < {HI}"
add("scan_metric_rows", lambda s, d: flat(select.scan_metric_rows(GAUGE(s, d), "events_value", LO, HI, limit=200, offset=50, max_series=100).rows, "event_type"), _PAGE + " ORDER BY event_type, t, event_id LIMIT 200 OFFSET 50")
add(
    "scan_series_rows",
    lambda s, d: flat(select.scan_series_rows(GAUGE(s, d), [("events_value", {"event_type": "view"}), ("events_value", CLICK), ("events_value", {"event_type": "view"})], LO, HI, limit=100, offset=20, max_series=3).rows, "event_type"),
    _PAGE + " AND event_type IN ('click', 'view') ORDER BY event_type = 'click', t, event_id LIMIT 100 OFFSET 20",
)
_PIECE = "list_concat([len({x}), 0], list_transform(string_split({x}, ''), lambda c: ascii(c)))"
_KEY = f"list_concat({_PIECE.format(x=chr(39) + 'events_value' + chr(39))}, {_PIECE.format(x=chr(39) + 'event_type' + chr(39))}, {_PIECE.format(x='event_type')})"
_FNV = f"list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform({_KEY}, lambda b: b::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_SHARDS = f"sh AS (SELECT event_type, CAST({_FNV} % 4 AS INTEGER) AS shard FROM (SELECT DISTINCT event_type FROM events))"
add("shard_of_series", lambda s, d: select.with_shard(GAUGE(s, d), 4).select(label(F.col("labels"), "event_type").alias("event_type"), F.col("shard").cast("int").alias("shard")).distinct(), f"WITH {_SHARDS} SELECT * FROM sh")
add("shards_in_part", lambda s, d: flat(select.in_shards(GAUGE(s, d), 4, [0, 3]), "event_type"), f"WITH {EV}, {_SHARDS} SELECT event_type, t AS ts, {R6('value')} AS value FROM ev JOIN sh USING (event_type) WHERE shard IN (0, 3)")
add(
    "scan_shard_window_rows",
    lambda s, d: flat(select.scan_shard_window_rows(GAUGE(s, d), 4, 1, LO, HI, limit=100, offset=10).rows, "event_type"),
    f"WITH {EV}, {_SHARDS} SELECT event_type, t AS ts, {R6('value')} AS value FROM ev JOIN sh USING (event_type) WHERE shard = 1 AND t >= {LO} AND t < {HI} ORDER BY event_type, t, event_id LIMIT 100 OFFSET 10",
)


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "snapshot")
    catalog.dump(GAUGE(spark, sf_dir), path, DAY)
    return flat(catalog.load(spark, path), "event_type")


add("snapshot_restore", _snapshot, f"WITH {EV} SELECT event_type, t AS ts, {R6('value')} AS value FROM ev")
add("query_points", lambda s, d: s.range(1).select(F.lit(catalog.range_points(START, END, DAY)).cast("long").alias("points")), f"SELECT CAST(({END} - {START}) // {DAY} + 1 AS BIGINT) AS points")


# Writing: a table that takes batches.

_WHOLE = f"WITH {EV} SELECT event_type, t AS ts, {R6('value')} AS value FROM ev"


def _table(spark: SparkSession, **options) -> SampleTable:
    return SampleTable(spark, scratch(spark, "samples"), **options)


def _inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, of which the last holds one row without a metric and so none of it counts."""
    df, table = GAUGE(spark, sf_dir), _table(spark)
    table.insert_rows(df.where(F.col("ts") < HI))
    table.insert_rows(df.where(F.col("ts") >= HI))
    try:
        table.insert_rows(df.withColumn("metric", F.when(F.col("seq") == 7, "").otherwise(F.col("metric"))))
    except InvalidRequest:
        return flat(table.read(), "event_type")
    raise AssertionError("a bad batch was accepted")


add("insert_rows", _inserted, _WHOLE)


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark)
    table.insert_rows(GAUGE(spark, sf_dir))
    bounds = {"hot_from": HI, "warm_from": LO}
    table.age(**bounds)
    return flat(table.read(LO + DAY, **bounds), "event_type")


add("tiered_read", _tiered, _WHOLE + f" WHERE t >= {LO + DAY}")


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup that a late batch and a delete fall into, read through the rollup."""
    df, policy = GAUGE(spark, sf_dir), rollups.Policy("late", "events_value", 6 * HOUR, "sum")
    store = rollups.Store(spark, scratch(spark, "rollups"))
    table = _table(spark, rollups=store, policies=(policy,))
    table.insert_rows(df.where("seq % 3 != 0"))
    store.run(table.read(), policy)
    table.insert_rows(df.where("seq % 3 = 0"))
    table.delete_series(select.select_series(df, "events_value", (select.Matcher("event_type", "=", "click"),)), LO + DAY, LO + 2 * DAY)
    out, used = store.downsample(table.read(), [policy], "events_value", CLICK, LO, HI, 6 * HOUR, "sum")
    assert used == policy.id
    return out.withColumn("value", F.round("value", SIX))


add("late_rollup", _late, f"WITH {EV} SELECT t // {6 * HOUR} * {6 * HOUR} AS ts, {R6('sum(value)')} AS value FROM ev WHERE event_type = 'click' AND t >= {LO} AND t < {HI} AND NOT (t >= {LO + DAY} AND t < {LO + 2 * DAY}) GROUP BY 1")


def _rule_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = rules.Group("g", DAY, (rules.Recording("type:sum", "sum by (event_type) (events_value)"),))
    table = _table(spark)
    for at in (END - DAY, END):
        rows, _, _ = rules.evaluate(Engine(USERS(spark, sf_dir), lookback_ms=DAY), group, at, spark.createDataFrame([], rules.STATE))
        table.insert_rows(rows[0])
    return flat(Engine(table.read(), lookback_ms=HOUR).range("type:sum", END - DAY, END, DAY), "event_type")


_DAYS = f"WITH {EV}, d AS (SELECT s FROM (VALUES ({END - DAY}), ({END})) x(s)), lv AS (SELECT s, event_type, user_id, arg_max(value, (t, -event_id)) AS v FROM ev JOIN d ON t >= s - {DAY} AND t <= s GROUP BY ALL) "
add("recording_rule_sink", _rule_sink, _DAYS + f"SELECT event_type, s AS ts, {R6('sum(v)')} AS value FROM lv GROUP BY ALL")

# Overlapping windows: two days, once a day.

_TWO = WIN.replace(f"6 * {HOUR}", f"2 * {DAY}")
for _name, _sql in {"avg": "list_avg(v)", "min": "list_min(v)", "max": "list_max(v)", "sum": "list_sum(v)", "count": "CAST(n AS DOUBLE)", "last": "v[-1]"}.items():
    add(f"overlapping_{_name}_over_time", ranged(GAUGE, f"{_name}_over_time(events_value[2d])", "event_type"), f"WITH {EV}, {STEPS}, {_TWO}, {ARR} SELECT event_type, s AS ts, {R6(_sql)} AS value FROM a")
add("overlapping_rate", ranged(tables.events_total, "rate(events_total[2d])", "event_type"), _extrapolated(f"inc / {2 * DAY / 1000}", 2 * DAY))
add("overlapping_delta", ranged(tables.events_total, "delta(events_total[2d])", "event_type"), _extrapolated("inc", 2 * DAY, counter=False))
_ADJACENT = "list_zip(v[:-2], v[2:])"
add("overlapping_changes", ranged(GAUGE, "changes(events_value[2d])", "event_type"), f"WITH {EV}, {STEPS}, {_TWO}, {ARR} SELECT event_type, s AS ts, CAST(len(list_filter({_ADJACENT}, lambda x: x[1] <> x[2])) AS DOUBLE) AS value FROM a")
add("overlapping_resets", ranged(GAUGE, "resets(events_value[2d])", "event_type"), f"WITH {EV}, {STEPS}, {_TWO}, {ARR} SELECT event_type, s AS ts, CAST(len(list_filter({_ADJACENT}, lambda x: x[2] < x[1])) AS DOUBLE) AS value FROM a")


# Migration and schedules.


def _captured(spark: SparkSession, sf_dir: str, form: str, line: str) -> DataFrame:
    """Bodies of the events of each user, written as a capture and read back."""
    lines = _lines(spark, sf_dir, line).withColumn("user", F.col("seq") % 40)
    bodies = lines.groupBy("user").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"])).alias("body"))
    record = F.struct((F.lit(START) + F.col("user")).alias("received_at_ms"), F.struct(F.lit("db").alias("db"), F.lit("ms").alias("precision")).alias("query_params"), "body")
    path = scratch(spark, "capture")
    # a capture is one array a file
    files = bodies.groupBy((F.col("user") % 4).alias("file")).agg(F.to_json(F.collect_list(record)).alias("value"))
    files.repartition("file").write.partitionBy("file").text(path)
    return captures.read_capture(spark, path, form)


add(
    "capture_line_protocol",
    lambda s, d: flat(_captured(s, d, "measurement", "concat('events,event_type=', event_type, ' value=', v, if(event_id % 2 = 0, concat(' ', ts), ''))"), "event_type"),
    f"WITH {EV} SELECT event_type, CASE WHEN event_id % 2 = 0 THEN t ELSE {START} + event_id % 40 END AS ts, {R6('value')} AS value FROM ev",
)
add(
    "capture_graphite",
    lambda s, d: flat(_captured(s, d, "graphite", "concat('events;event_type=', event_type, ' ', v, ' ', ts div 1000)"), "event_type"),
    f"WITH {EV} SELECT event_type, t // 1000 * 1000 AS ts, {R6('value')} AS value FROM ev",
)
add(
    "capture_statsd",
    lambda s, d: flat(_captured(s, d, "statsd", "concat('hits:', event_id % 7, '|c|#event_type:', event_type)"), "event_type"),
    f"WITH {EV} SELECT event_type, {START} + event_id % 40 AS ts, CAST(event_id % 7 AS DOUBLE) AS value FROM ev",
)


def _migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums moved to a table in ten-day windows, one of them twice, and read after the cutover."""
    source = A.downsample(GAUGE(spark, sf_dir), HOUR, "sum", origin=0)
    move = captures.Migration(source, _table(spark))
    move.backfill(START, START + 10 * DAY, 10 * DAY)
    move.backfill(START, END + DAY, 10 * DAY)
    return flat(move.cutover(START, END + DAY).read(), "event_type")


add("migration_cutover", _migrated, f"WITH {EV} SELECT event_type, t // {HOUR} * {HOUR} AS ts, {R6('sum(value)')} AS value FROM ev GROUP BY ALL")


def _scheduled(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    table = _table(spark)
    table.insert_rows(USERS(spark, sf_dir))
    recording = rules.Group("record", DAY, (rules.Recording("type:sum", "sum by (event_type) (events_value)"),))
    alerting = rules.Group("alerts", HOUR, (rules.Alert("busy", "count by (event_type) (events_value) > 0", for_=2 * HOUR),))
    run = Scheduler(table, (recording, alerting), scratch(spark, "rules"), lookback_ms=DAY)
    for now in (END - DAY, END - 2 * HOUR, END - 2 * HOUR + 60_000, END):
        run.tick(now)
    if what == "alerts":
        return run.state(alerting).select("rule", label(F.col("labels"), "event_type").alias("event_type"), "firing", "value")
    return flat(table.read().where("metric = 'type:sum'"), "event_type")


add("scheduled_recordings", lambda s, d: _scheduled(s, d, "rows"), _DAYS + f"SELECT event_type, s AS ts, {R6('sum(v)')} AS value FROM lv GROUP BY ALL")
add("scheduled_alerts", lambda s, d: _scheduled(s, d, "alerts"), _latest("SELECT 'busy' AS rule, event_type, true AS firing, CAST(count(*) AS DOUBLE) AS value FROM lv GROUP BY ALL"))


# The hash-ordered choices: XXH64 (seed 0) of a series' identity in 128-bit arithmetic. Its five primes.

P1, P2, P3, P4, P5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_M = f"{1 << 64}::UHUGEINT"


def _rotated(x: str, r: int) -> str:
    return f"(({x}) * {1 << r}::UHUGEINT % {_M} + ({x}) // {1 << (64 - r)}::UHUGEINT)"


#: Series ``e{{u="..."}}`` with fewer than eight characters in u: eight bytes, then at most one of four, then single ones.
_XXH = f"""u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS u FROM events),
x0 AS (SELECT u, CAST(len(u) AS UHUGEINT) AS n, list_transform(string_split(u, ''), lambda c: CAST(ascii(c) AS UHUGEINT)) AS b FROM u),
x1 AS (SELECT *, ({1 + (101 << 16) + (1 << 24) + (117 << 40)}::UHUGEINT + n * {1 << 48}::UHUGEINT) * {P2} % {_M} AS k FROM x0),
x2 AS (SELECT u, n, b, xor(({P5} + 8::UHUGEINT + n) % {_M}, {_rotated("k", 31)} * {P1} % {_M}) AS h FROM x1),
x3 AS (SELECT u, n, b, ({_rotated("h", 27)} * {P1} % {_M} + {P4}) % {_M} AS h FROM x2),
x4 AS (SELECT u, n, b, CASE WHEN n >= 4 THEN xor(h, (b[1] + b[2] * 256::UHUGEINT + b[3] * 65536::UHUGEINT + b[4] * 16777216::UHUGEINT) * {P1} % {_M}) ELSE h END AS h FROM x3),
x5 AS (SELECT u, CASE WHEN n >= 4 THEN b[5:] ELSE b END AS b, CASE WHEN n >= 4 THEN ({_rotated("h", 23)} * {P2} % {_M} + {P3}) % {_M} ELSE h END AS h FROM x4),
x6 AS (SELECT u, list_reduce(list_prepend(h, b), lambda a, c: {_rotated(f"xor(a, c * {P5} % {_M})", 11)} * {P1} % {_M}) AS h FROM x5),
x7 AS (SELECT u, xor(h, h // {1 << 33}::UHUGEINT) * {P2} % {_M} AS h FROM x6),
x8 AS (SELECT u, xor(h, h // {1 << 29}::UHUGEINT) * {P3} % {_M} AS h FROM x7),
hashed AS (SELECT u, xor(h, h // {1 << 32}::UHUGEINT) AS h FROM x8)"""


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = USERS(spark, sf_dir).withColumn("metric", F.lit("e"))
    return df.withColumn("labels", labels_of(u="label_user_id")).drop("label_event_type", "label_user_id")


_CHOSEN = f"WITH {EV}, lv AS (SELECT CAST(user_id AS VARCHAR) AS u, max(t) AS ts, arg_max(value, (t, -event_id)) AS v FROM ev WHERE t >= {END} - {DAY} AND t <= {END} GROUP BY 1), {_XXH}, r AS (SELECT u, ts, {R6('v')} AS value, row_number() OVER (ORDER BY h) AS k, count(*) OVER () AS n FROM lv JOIN hashed USING (u)) SELECT u, ts, value FROM r WHERE "
add("limitk_by_hash", instant(_short, "limitk(7, e)", "u"), _CHOSEN + "k <= 7")
add("limit_ratio_by_hash", instant(_short, "limit_ratio(0.3, e)", "u"), _CHOSEN + "k <= floor(n * 0.3)")
add("limit_ratio_rest_by_hash", instant(_short, "limit_ratio(-0.3, e)", "u"), _CHOSEN + "k > n - floor(n * 0.3)")
ORACLES["range_holt_winters"] = ORACLES["range_double_exponential_smoothing"]
