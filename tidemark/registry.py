"""The engine's registered queries over the test tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import label
from .operators import aggregations as A
from .operators import catalog, select
from .plans.compiler import Engine
from .sources import tables
from .streaming import rollups, rules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY, HOUR = 86_400_000, 3_600_000
START = 1_704_067_200_000
END = START + 30 * DAY
FIRST = START + DAY
EV = "ev AS (SELECT event_id, event_type, user_id, value, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS t FROM events)"
TOTAL = "tot AS (SELECT event_type, t, us, event_id, CAST(count(*) OVER (PARTITION BY event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS v FROM ev)"
STEPS = f"st AS (SELECT {FIRST} + {DAY} * i AS s FROM range(29) r(i))"
SIX = 6


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def flat(df: DataFrame, *names: str, at: bool = True) -> DataFrame:
    """Labels as columns, value rounded."""
    cols = [label(F.col("labels"), n).alias(n) for n in names]
    return df.select(*cols, *(["ts"] if at else []), F.round("value", SIX).alias("value"))


def ranged(source: Query, query: str, *names: str, step: int = DAY, start: int = FIRST, end: int = END - DAY) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(Engine(source(spark, sf_dir)).range(query, start, end, step), *names)

    return run


def instant(source: Query, query: str, *names: str, at: int = END, ts: bool = True, lookback_ms: int = DAY) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(Engine(source(spark, sf_dir), lookback_ms=lookback_ms).instant(query, at), *names, at=ts)

    return run


# Range functions: 6 h windows of the gauge by type, once a day.

GAUGE = tables.events_by_type
WIN = f"w AS (SELECT s, event_type, t, us, event_id, value AS v FROM st JOIN ev ON t > s - 6 * {HOUR} AND t <= s)"
ARR = "a AS (SELECT s, event_type, list(v ORDER BY t, event_id) AS v, list(t ORDER BY t, event_id) AS t, count(*) AS n FROM w GROUP BY ALL)"


def _window(value: str, *, where: str = "true") -> str:
    return f"WITH {EV}, {STEPS}, {WIN}, {ARR} SELECT event_type, s AS ts, round({value}, {SIX}) AS value FROM a WHERE {where}"


_PAIRS = "list_zip(v[:-2], v[2:])"
for _name, _sql in {
    "avg": "list_avg(v)",
    "sum": "list_sum(v)",
    "min": "list_min(v)",
    "max": "list_max(v)",
    "count": "CAST(n AS DOUBLE)",
    "last": "v[-1]",
    "present": "1.0::DOUBLE",
    "stddev": "list_stddev_pop(v)",
    "stdvar": "list_var_pop(v)",
}.items():
    add(f"range_{_name}_over_time", ranged(GAUGE, f"{_name}_over_time(events_value[6h])", "event_type"), _window(_sql))
add("range_quantile_over_time", ranged(GAUGE, "quantile_over_time(0.3, events_value[6h])", "event_type"), _window("list_aggregate(v, 'quantile_cont', 0.3)"))
add("range_mad_over_time", ranged(GAUGE, "mad_over_time(events_value[6h])", "event_type"), _window("list_aggregate(v, 'mad')"))
add("range_changes", ranged(GAUGE, "changes(events_value[6h])", "event_type"), _window(f"CAST(len(list_filter({_PAIRS}, lambda x: x[1] <> x[2])) AS DOUBLE)"))
add("range_resets", ranged(GAUGE, "resets(events_value[6h])", "event_type"), _window(f"CAST(len(list_filter({_PAIRS}, lambda x: x[2] < x[1])) AS DOUBLE)"))
add("range_idelta", ranged(GAUGE, "idelta(events_value[6h])", "event_type"), _window("v[-1] - v[-2]", where="n > 1"))
_X = "((t - t[1]) / 1000.0)"
REG = f"""WITH {EV}, {STEPS}, {WIN},
f AS (SELECT s, event_type, min(t) AS t0 FROM w GROUP BY ALL),
p AS (SELECT s, event_type, t0, (t - t0) / 1000.0 AS x, v AS y FROM w JOIN f USING (s, event_type)),
q AS (SELECT s, event_type, t0, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx FROM p GROUP BY ALL),
l AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM q WHERE n > 1 AND n * sxx - sx * sx <> 0)
SELECT event_type, s AS ts, round({{}}, {SIX}) AS value FROM l"""
add("range_deriv", ranged(GAUGE, "deriv(events_value[6h])", "event_type"), REG.format("slope"))
add("range_predict_linear", ranged(GAUGE, "predict_linear(events_value[6h], 600)", "event_type"), REG.format("slope * ((s - t0) / 1000.0 + 600) + (sy - slope * sx) / n"))
add("range_holt_winters", ranged(GAUGE, "holt_winters(events_value[6h], 0.5, 0.1)", "event_type"))

# Counters: extrapolation over the running count.

COUNTER = tables.events_total
_EXT = f"""WITH {EV}, {TOTAL}, {STEPS},
w AS (SELECT s, event_type, t, us, event_id, v FROM st JOIN tot ON t > s - {{d}} AND t <= s),
e AS (SELECT s, event_type, count(*) AS n, min(t) AS t0, max(t) AS t1, min(v) AS v0, max(v) AS v1 FROM w GROUP BY ALL HAVING count(*) > 1 AND max(t) > min(t)),
g AS (SELECT *, (t1 - t0)::DOUBLE AS span, v1 - v0 AS raw, (t1 - t0) / (n - 1)::DOUBLE AS gap, least((t0 - (s - {{d}}))::DOUBLE, (t1 - t0) * (v0 / (v1 - v0))) AS b0, (t0 - (s - {{d}}))::DOUBLE AS b1, (s - t1)::DOUBLE AS aft FROM e),
x AS (SELECT *, CASE WHEN {{counter}} THEN b0 ELSE b1 END AS bef FROM g),
r AS (SELECT s, event_type, raw * ((span + CASE WHEN bef < gap * 1.1 THEN bef ELSE gap / 2 END + CASE WHEN aft < gap * 1.1 THEN aft ELSE gap / 2 END) / span) AS inc FROM x)
"""


def _extrapolated(value: str, d: int = 6 * HOUR, counter: bool = True) -> str:
    return _EXT.format(d=d, counter=str(counter).lower()) + f"SELECT event_type, s AS ts, round({value}, {SIX}) AS value FROM r"


add("range_increase", ranged(COUNTER, "increase(events_total[6h])", "event_type"), _extrapolated("inc"))
add("range_rate", ranged(COUNTER, "rate(events_total[6h])", "event_type"), _extrapolated(f"inc / {6 * HOUR / 1000}"))
add("range_delta", ranged(COUNTER, "delta(events_total[6h])", "event_type"), _extrapolated("inc", counter=False))
add(
    "range_irate",
    ranged(COUNTER, "irate(events_total[6h])", "event_type"),
    f"WITH {EV}, {TOTAL}, {STEPS}, w AS (SELECT s, event_type, t, event_id, v FROM st JOIN tot ON t > s - 6 * {HOUR} AND t <= s), {ARR} "
    f"SELECT event_type, s AS ts, round((v[-1] - v[-2]) / ((t[-1] - t[-2]) / 1000.0), {SIX}) AS value FROM a WHERE n > 1 AND t[-1] > t[-2]",
)
FLAGSHIP = ranged(COUNTER, "sum by (event_type) (rate(events_total[6h]))", "event_type")
add("flagship_rate_by_type", FLAGSHIP, _extrapolated(f"inc / {6 * HOUR / 1000}"))

# Instant vectors: the newest value by (type, user) of the last day.

USERS = tables.events_value
_LATEST = f"WITH {EV}, lv AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, max(t) AS ts, arg_max(value, (t, -event_id)) AS v FROM ev WHERE t >= {END} - {DAY} AND t <= {END} GROUP BY 1, 2) "


def _latest(sql: str) -> str:
    return _LATEST + sql


R6 = lambda x: f"round({x}, {SIX})"
add("instant_lookback", instant(USERS, "events_value", "event_type", "user_id"), _latest(f"SELECT event_type, user_id, ts, {R6('v')} AS value FROM lv"))
add("instant_matchers", instant(USERS, 'events_value{event_type=~"click|view",user_id!~"1.*"}', "event_type", "user_id"), _latest(f"SELECT event_type, user_id, ts, {R6('v')} AS value FROM lv WHERE event_type IN ('click', 'view') AND NOT starts_with(user_id, '1')"))
for _name, _sql in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "CAST(count(*) AS DOUBLE)", "group": "1.0::DOUBLE", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items():
    add(f"agg_{_name}", instant(USERS, f"{_name} by (event_type) (events_value)", "event_type"), _latest(f"SELECT event_type, max(ts) AS ts, {R6(_sql)} AS value FROM lv GROUP BY 1"))
add("agg_without", instant(USERS, "sum without (user_id) (events_value)", "event_type"), ORACLES["agg_sum"])
add("agg_quantile", instant(USERS, "quantile by (event_type) (0.9, events_value)", "event_type"), _latest(f"SELECT event_type, max(ts) AS ts, {R6('quantile_cont(v, 0.9)')} AS value FROM lv GROUP BY 1"))
_TOP = "SELECT event_type, user_id, ts, {r} AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v {d}, user_id) AS k FROM lv) WHERE k <= 3"
add("agg_topk", instant(USERS, "topk by (event_type) (3, events_value)", "event_type", "user_id"), _latest(_TOP.format(d="DESC", r=R6("v"))))
add("agg_bottomk", instant(USERS, "bottomk by (event_type) (3, events_value)", "event_type", "user_id"), _latest(_TOP.format(d="ASC", r=R6("v"))))
add("agg_count_values", instant(USERS, 'count_values("v", floor(events_value / 10))', "v"), _latest("SELECT CAST(CAST(floor(v / 10) AS BIGINT) AS VARCHAR) AS v, max(ts) AS ts, CAST(count(*) AS DOUBLE) AS value FROM lv GROUP BY 1"))
add("agg_limitk", instant(USERS, "limitk by (event_type) (2, events_value)", "event_type", "user_id"))
add("agg_limit_ratio", instant(USERS, "limit_ratio(0.25, events_value)", "event_type", "user_id"))

add("bin_arith_scalar", instant(USERS, "(events_value * 2 - 1) / 3 + events_value % 7 ^ 1", "event_type", "user_id"), _latest(f"SELECT event_type, user_id, ts, {R6('(v * 2 - 1) / 3 + v % 7')} AS value FROM lv"))
add("bin_filter", instant(USERS, "events_value > 20", "event_type", "user_id"), _latest(f"SELECT event_type, user_id, ts, {R6('v')} AS value FROM lv WHERE v > 20"))
add("bin_bool", instant(USERS, "events_value >= bool 20", "event_type", "user_id"), _latest("SELECT event_type, user_id, ts, CAST(v >= 20 AS INT)::DOUBLE AS value FROM lv"))
add("bin_division_by_zero", instant(USERS, "sgn(events_value / 0) + 0 * events_value", "event_type", "user_id"), _latest("SELECT event_type, user_id, ts, 1.0::DOUBLE AS value FROM lv WHERE v > 0"))
add("match_one_to_one", instant(USERS, 'events_value{event_type="click"} - on(user_id) events_value{event_type="view"}', "user_id"), _latest(f"SELECT a.user_id, greatest(a.ts, b.ts) AS ts, {R6('a.v - b.v')} AS value FROM lv a JOIN lv b USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'view'"))
add("match_group_left", instant(USERS, "events_value / on(event_type) group_left() sum by (event_type) (events_value)", "event_type", "user_id"), _latest(f"SELECT lv.event_type, user_id, greatest(lv.ts, g.ts) AS ts, {R6('v / g.s')} AS value FROM lv JOIN (SELECT event_type, sum(v) AS s, max(ts) AS ts FROM lv GROUP BY 1) g USING (event_type)"))
add("match_group_right", instant(USERS, "sum by (event_type) (events_value) - on(event_type) group_right() events_value", "event_type", "user_id"), _latest(f"SELECT lv.event_type, user_id, greatest(lv.ts, g.ts) AS ts, {R6('g.s - v')} AS value FROM lv JOIN (SELECT event_type, sum(v) AS s, max(ts) AS ts FROM lv GROUP BY 1) g USING (event_type)"))
_CV = "SELECT event_type, user_id, ts, " + R6("v") + " AS value FROM lv a WHERE event_type = 'click' AND {n} EXISTS (SELECT 1 FROM lv b WHERE b.event_type = 'view' AND b.user_id = a.user_id)"
add("set_and", instant(USERS, 'events_value{event_type="click"} and on(user_id) events_value{event_type="view"}', "event_type", "user_id"), _latest(_CV.format(n="")))
add("set_unless", instant(USERS, 'events_value{event_type="click"} unless on(user_id) events_value{event_type="view"}', "event_type", "user_id"), _latest(_CV.format(n="NOT")))
add("set_or", instant(USERS, 'events_value{event_type="view"} or on(user_id) events_value{event_type="click"}', "event_type", "user_id"), _latest(_CV.format(n="NOT") + f" UNION ALL SELECT event_type, user_id, ts, {R6('v')} FROM lv WHERE event_type = 'view'"))
add("unary_minus", instant(USERS, "-events_value", "event_type", "user_id"), _latest(f"SELECT event_type, user_id, ts, {R6('-v')} AS value FROM lv"))

_SHIFT = f"WITH {EV} SELECT event_type, max(t) AS ts, round(arg_max(value, (t, -event_id)), {SIX}) AS value FROM ev WHERE t >= {END} - 9 * {DAY} AND t <= {END} - 8 * {DAY} GROUP BY 1"
add("offset", instant(GAUGE, "events_value offset 8d", "event_type"), _SHIFT)
add("at_modifier", instant(GAUGE, f"events_value @ {(END - 8 * DAY) // 1000}", "event_type"), _SHIFT)
add(
    "subquery_max",
    ranged(GAUGE, "max_over_time(sum_over_time(events_value[2h])[12h:3h])", "event_type"),
    f"WITH {EV}, {STEPS}, inn AS (SELECT s, s - {12 * HOUR} + k * {3 * HOUR} AS u FROM st, range(5) r(k)), sm AS (SELECT s, u, event_type, sum(value) AS v FROM inn JOIN ev ON t > u - {2 * HOUR} AND t <= u GROUP BY ALL) SELECT event_type, s AS ts, round(max(v), {SIX}) AS value FROM sm GROUP BY ALL",
)
for _f, _sql in {
    "abs": "abs(x)", "ceil": "ceil(x)", "floor": "floor(x)", "sqrt": "sqrt(v)", "exp": "exp(v / 100)", "ln": "ln(v)", "log2": "log2(v)", "log10": "log10(v)", "sgn": "CASE WHEN x < 0 THEN -1.0 ELSE 1.0 END::DOUBLE",
    "sin": "sin(v)", "cos": "cos(v)", "atan": "atan(v)", "sinh": "sinh(v / 100)", "tanh": "tanh(v / 100)", "asinh": "asinh(v)", "deg": "degrees(v)", "rad": "radians(v)",
}.items():
    _arg = {"exp": "events_value / 100", "sinh": "events_value / 100", "tanh": "events_value / 100"}.get(_f, "(events_value - 20)" if "x" in _sql.replace("exp", "") else "events_value")
    add(f"math_{_f}", instant(USERS, f"{_f}({_arg})", "event_type", "user_id"), _latest(f"SELECT event_type, user_id, ts, {R6(_sql)} AS value FROM (SELECT *, v - 20 AS x FROM lv)"))
add("math_round", instant(USERS, "round(events_value, 5)", "event_type", "user_id"), _latest("SELECT event_type, user_id, ts, round(floor(v / 5 + 0.5) * 5, 6) AS value FROM lv"))
add("math_clamp", instant(USERS, "clamp_max(clamp_min(clamp(events_value, 5, 60), 10), 50)", "event_type", "user_id"), _latest(f"SELECT event_type, user_id, ts, {R6('least(greatest(v, 10), 50)')} AS value FROM lv"))
for _f, _sql in {"minute": "minute(d)", "hour": "hour(d)", "day_of_week": "dayofweek(d)", "day_of_month": "day(d)", "day_of_year": "dayofyear(d)", "days_in_month": "day(last_day(d))", "month": "month(d)", "year": "year(d)"}.items():
    add(f"time_{_f}", instant(USERS, f"{_f}(timestamp(events_value))", "event_type", "user_id"), _latest(f"SELECT event_type, user_id, ts, CAST({_sql} AS DOUBLE) AS value FROM (SELECT *, make_timestamp(ts // 1000 * 1000000) AS d FROM lv)"))
add("timestamp_fn", instant(USERS, "timestamp(events_value)", "event_type", "user_id"), _latest(f"SELECT event_type, user_id, ts, {R6('ts / 1000.0')} AS value FROM lv"))
add("time_fn", ranged(GAUGE, "time() + pi() * 0"), f"WITH {STEPS} SELECT s AS ts, round(s / 1000.0, {SIX}) AS value FROM st")
add("scalar_vector", instant(USERS, "vector(scalar(sum(events_value))) + count_scalar(events_value)", ts=False), _latest(f"SELECT {R6('sum(v) + count(*)')} AS value FROM lv"))
add("absent", ranged(GAUGE, 'absent(events_value{event_type="nothing"})', "event_type"), f"WITH {STEPS} SELECT 'nothing' AS event_type, s AS ts, 1.0::DOUBLE AS value FROM st")
add("absent_over_time", ranged(GAUGE, "absent_over_time(events_value[1m])"), f"WITH {EV}, {STEPS} SELECT s AS ts, 1.0::DOUBLE AS value FROM st WHERE NOT EXISTS (SELECT 1 FROM ev WHERE t > s - 60000 AND t <= s)")
add("label_replace", instant(USERS, 'label_replace(events_value, "kind", "$1-x", "event_type", "(..).*")', "event_type", "user_id", "kind"), _latest(f"SELECT event_type, user_id, event_type[1:2] || '-x' AS kind, ts, {R6('v')} AS value FROM lv"))
add("label_join", instant(USERS, 'label_join(events_value, "both", "/", "event_type", "user_id")', "both"), _latest(f"SELECT event_type || '/' || user_id AS both, ts, {R6('v')} AS value FROM lv"))
add("drop_common_labels", instant(USERS, 'drop_common_labels(events_value{event_type="click"})', "event_type", "user_id"), _latest(f"SELECT '' AS event_type, user_id, ts, {R6('v')} AS value FROM lv WHERE event_type = 'click'"))
add("sort_by_value", instant(USERS, "sort_desc(events_value)", "event_type", "user_id"), ORACLES["instant_lookback"])
add("sort_by_label", instant(USERS, 'sort_by_label(events_value, "user_id")', "event_type", "user_id"), ORACLES["instant_lookback"])

BOUNDS = ("10", "50", "100", "250", "+Inf")


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative bucket counts of a day's values by type, as samples at the day's end."""
    df = tables.events_by_type(spark, sf_dir).withColumn("ts", F.col("ts") - F.pmod("ts", F.lit(DAY)) + DAY)
    counts = [F.count(F.when(F.col("value") <= float(b.replace("+", "")), 1)).alias(b) for b in BOUNDS]
    wide = df.groupBy("label_event_type", "ts").agg(*counts)
    long = wide.select("label_event_type", "ts", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"`{b}`").cast("double").alias("value")) for b in BOUNDS])).alias("x"))
    labels = F.array(F.struct(F.lit("event_type").alias("name"), F.col("label_event_type").alias("value")), F.struct(F.lit("le").alias("name"), F.col("x.le").alias("value")))
    return long.select(F.lit("event_value_bucket").alias("metric"), labels.alias("labels"), "ts", F.lit(0).cast("long").alias("seq"), "x.value", F.lit(False).alias("is_stale"))


_HQ = f"""WITH {EV}, h AS (SELECT event_type, t // {DAY} * {DAY} + {DAY} AS ts, count(*) FILTER (value <= 10) AS c1, count(*) FILTER (value <= 50) AS c2, count(*) FILTER (value <= 100) AS c3, count(*) FILTER (value <= 250) AS c4, count(*) AS c5 FROM ev GROUP BY ALL),
r AS (SELECT *, 0.6 * c5 AS k FROM h)
SELECT event_type, ts, round(CASE WHEN k <= c1 THEN 10 * (k / c1) WHEN k <= c2 THEN 10 + 40 * ((k - c1) / (c2 - c1)) WHEN k <= c3 THEN 50 + 50 * ((k - c2) / (c3 - c2)) WHEN k <= c4 THEN 100 + 150 * ((k - c3) / (c4 - c3)) ELSE 250 END, {SIX}) AS value
FROM r WHERE ts >= {FIRST} AND ts <= {END - DAY}"""
add("hist_quantile_classic", ranged(_histogram, "histogram_quantile(0.6, event_value_bucket)", "event_type"), _HQ)

# Select API.

LINES = tables.lineitem_quantity


def _lines(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(LINES(spark, sf_dir))


def _gauge(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(GAUGE(spark, sf_dir))


CLICK = {"event_type": "click"}
LO, HI = START + 2 * DAY, START + 12 * DAY
rounded = lambda df: df.withColumn("value", F.round("value", SIX))
_CLICK = f"WITH {EV}, c AS (SELECT * FROM ev WHERE event_type = 'click' AND t >= {LO} AND t < {HI}) "
add("select_range", _gauge(lambda df: rounded(select.select(df, "events_value", CLICK, LO, HI))), _CLICK + f"SELECT t AS ts, {R6('value')} AS value FROM c")
add("select_unknown", _gauge(lambda df: rounded(select.select(df, "events_value", {}, LO, HI))), _CLICK + "SELECT t AS ts, value FROM c WHERE false")
add("select_page", _gauge(lambda df: rounded(select.select_with_options(df, "events_value", select.Options(CLICK, LO, HI, limit=25, offset=10)))), _CLICK + f"SELECT t AS ts, {R6('value')} AS value FROM c ORDER BY t, event_id LIMIT 25 OFFSET 10")
add("select_all", _gauge(lambda df: flat(select.select_all(df, "events_value", LO, HI), "event_type")), f"WITH {EV} SELECT event_type, t AS ts, {R6('value')} AS value FROM ev WHERE t >= {LO} AND t < {HI}")
add("select_many", _gauge(lambda df: select.select_many(df, [("events_value", CLICK), ("events_value", {"event_type": "none"}), ("events_value", {"event_type": "view"})], LO, HI).select("ordinal", F.size("points").alias("n"))), f"WITH {EV} SELECT o::INTEGER AS ordinal, CAST((SELECT count(*) FROM ev WHERE event_type = k AND t >= {LO} AND t < {HI}) AS INTEGER) AS n FROM (VALUES (0, 'click'), (1, 'none'), (2, 'view')) x(o, k)")
add("select_series", _lines(lambda df: select.select_series(df, None, (select.Matcher("l_returnflag", "=~", "A|R"), select.Matcher("__name__", "=", "lineitem_quantity"))).select("metric", label(F.col("labels"), "l_returnflag").alias("l_returnflag"), label(F.col("labels"), "l_linestatus").alias("l_linestatus"))), "SELECT DISTINCT 'lineitem_quantity' AS metric, l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag IN ('A', 'R')")
_SQL_AGG = {
    "sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "first": "arg_min(v, (t, o))", "last": "arg_max(v, (t, o))", "count": "count(*)",
    "median": "quantile_cont(v, 0.5)", "range": "max(v) - min(v)", "variance": "var_pop(v)", "stddev": "stddev_pop(v)",
}
_LI = "WITH li AS (SELECT l_returnflag, l_linestatus, epoch_ms(CAST(l_shipdate AS TIMESTAMP)) AS t, l_orderkey * 10 + l_linenumber AS o, CAST(l_quantity AS DOUBLE) AS v FROM lineitem) "
_LABELS = ("l_returnflag", "l_linestatus")
for _name, _sql in _SQL_AGG.items():
    _round = (lambda x: x) if _name == "count" else R6
    _flat = (lambda df: df.select(*[label(F.col("labels"), n).alias(n) for n in _LABELS], "ts", "value")) if _name == "count" else (lambda df: flat(df, *_LABELS))
    add(f"downsample_{_name}", _lines(lambda df, n=_name, f=_flat: f(A.downsample(df, 30 * DAY, n, origin=0))), _LI + f"SELECT l_returnflag, l_linestatus, t // {30 * DAY} * {30 * DAY} AS ts, {_round(_sql)} AS value FROM li GROUP BY ALL")
    _at = {"first": "min(t)", "min": "arg_min(t, (v, t, o))", "max": "arg_min(t, (-v, t, o))"}.get(_name, "max(t)")
    add(f"series_agg_{_name}", _lines(lambda df, n=_name, f=_flat: f(A.whole(df, n))), _LI + f"SELECT l_returnflag, l_linestatus, {_at} AS ts, {_round(_sql)} AS value FROM li GROUP BY ALL")
add("downsample_options", _gauge(lambda df: rounded(select.select_with_options(df, "events_value", select.Options(CLICK, LO, HI, "avg", 7 * HOUR, limit=12, offset=3)))), _CLICK + f"SELECT ts, value FROM (SELECT {LO} + (t - {LO}) // {7 * HOUR} * {7 * HOUR} AS ts, {R6('avg(value)')} AS value FROM c GROUP BY 1) ORDER BY ts LIMIT 12 OFFSET 3")
add("list_metrics", _gauge(lambda df: select.list_metrics(df).select("metric", label(F.col("labels"), "event_type").alias("event_type"))), "SELECT DISTINCT 'events_value' AS metric, event_type FROM events")
add("label_names", lambda spark, sf_dir: catalog.label_names(USERS(spark, sf_dir)), "SELECT * FROM (VALUES ('__name__'), ('event_type'), ('user_id')) t(name)")
add("label_values", lambda spark, sf_dir: catalog.label_values(USERS(spark, sf_dir), "user_id"), "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events")
add("series_match", _gauge(lambda df: catalog.series_of([select.select_series(df, "events_value", (select.Matcher("event_type", "=", "click"),)), select.select_series(df, "events_value", (select.Matcher("event_type", "=~", "c.*|v.*"),))]).select(label(F.col("labels"), "__name__").alias("name"), label(F.col("labels"), "event_type").alias("event_type"))), "SELECT DISTINCT 'events_value' AS name, event_type FROM events WHERE event_type LIKE 'c%' OR event_type LIKE 'v%'")
add("retention_filter", _gauge(lambda df: flat(catalog.retained(df, catalog.retention_reference(df, START, 1000, 40 * 86_400), 5 * DAY), "event_type")), f"WITH {EV} SELECT event_type, t AS ts, {R6('value')} AS value FROM ev WHERE t >= (SELECT max(t) FROM ev) - {5 * DAY}")


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = GAUGE(spark, sf_dir)
    empty = spark.createDataFrame([], catalog.EMPTY_TOMBSTONES)
    stones, _, _ = catalog.tombstone(empty, select.select_series(df, "events_value", (select.Matcher("event_type", "=", "click"),)), LO, HI)
    stones, _, _ = catalog.tombstone(stones, select.select_series(df, "events_value", (select.Matcher("event_type", "=~", "click|view"),)), HI - DAY, HI + DAY)
    return flat(catalog.without_deleted(df, stones), "event_type")


add("delete_tombstone", _deleted, f"WITH {EV} SELECT event_type, t AS ts, {R6('value')} AS value FROM ev WHERE NOT (event_type = 'click' AND t >= {LO} AND t < {HI + DAY}) AND NOT (event_type = 'view' AND t >= {HI - DAY} AND t < {HI + DAY})")
add("tenant_scope", _gauge(lambda df: flat(catalog.scoped(catalog.stamped(df.where("label_event_type = 'click'"), "a").unionByName(df.where("label_event_type = 'view'")), catalog.DEFAULT_TENANT), "event_type")), f"WITH {EV} SELECT event_type, t AS ts, {R6('value')} AS value FROM ev WHERE event_type = 'view'")
add("replica_merge", _gauge(lambda df: flat(catalog.merge_replicas([df.where(F.col("ts") < HI), df.where(F.col("ts") >= LO)]), "event_type")), f"WITH {EV} SELECT DISTINCT event_type, t AS ts, {R6('value')} AS value FROM ev")
add("shard_scope", _gauge(lambda df: select.in_shards(df, 8, list(range(8))).groupBy(label(F.col("labels"), "event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))), "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
add("shard_digest", _gauge(lambda df: select.shard_digest(df, 8, LO, HI)))


def _rollup(spark: SparkSession, sf_dir: str, *, start: int, end: int) -> DataFrame:
    from .session import scratch

    df = GAUGE(spark, sf_dir)
    policy = rollups.Policy("hourly", "events_value", 6 * HOUR, "sum")
    store = rollups.Store(spark, scratch(spark, "rollups"))
    store.run(df.where(F.col("ts") < START + 20 * DAY), policy)
    out, used = store.downsample(df, [policy], "events_value", CLICK, start, end, 6 * HOUR, "sum")
    assert used == policy.id
    return rounded(out)


def _rolled(start: int, end: int) -> str:
    return f"WITH {EV} SELECT t // {6 * HOUR} * {6 * HOUR} AS ts, {R6('sum(value)')} AS value FROM ev WHERE event_type = 'click' AND t >= {start} AND t < {end} GROUP BY 1"


add("rollup_hit", lambda s, d: _rollup(s, d, start=LO, end=HI), _rolled(LO, HI))
add("rollup_partial", lambda s, d: _rollup(s, d, start=LO, end=START + 28 * DAY), _rolled(LO, START + 28 * DAY))


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = rules.Group("g", DAY, (rules.Recording("type:sum", "sum by (event_type) (events_value)", {"source": "rule"}),), {"team": "core"})
    rows, _, _ = rules.evaluate(Engine(USERS(spark, sf_dir), lookback_ms=DAY), group, END, spark.createDataFrame([], rules.STATE))
    return flat(rows[0], "event_type", "source", "team")


add("recording_rule", _recorded, _latest(f"SELECT event_type, 'rule' AS source, 'core' AS team, {END}::BIGINT AS ts, {R6('sum(v)')} AS value FROM lv GROUP BY 1"))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(USERS(spark, sf_dir), lookback_ms=DAY)
    group = rules.Group("g", HOUR, (rules.Alert("busy", "count by (event_type) (events_value) > 0", for_=2 * HOUR),))
    _, state, at = rules.evaluate(engine, group, END - 2 * HOUR, spark.createDataFrame([], rules.STATE))
    _, state, _ = rules.evaluate(engine, group, END, state, at)
    return state.select("rule", label(F.col("labels"), "event_type").alias("event_type"), "active_since", "firing", "value")


add("alert_state", _alerts, _latest(f"SELECT 'busy' AS rule, event_type, {END - 2 * HOUR}::BIGINT AS active_since, true AS firing, CAST(count(*) AS DOUBLE) AS value FROM lv GROUP BY ALL"))

from . import registry_more  # noqa: E402, F401  registers its queries here
