import math
import time

import pytest

from tests.fixtures import BUCKETS, COUNTER, MATCHING, RANGES, samples
from tidemark.errors import ArgumentCount, EvalError, ParseError, TypeMismatch, UnknownFunction
from tidemark.plans.compiler import Engine


@pytest.fixture(scope="module")
def engine(spark):
    df = samples(spark, *COUNTER, *RANGES, *MATCHING, *BUCKETS).coalesce(1).cache()
    return Engine(df, units=1)


def run(engine, query, at):
    return sorted((tuple((x.name, x.value) for x in r.labels), r.value) for r in engine.instant(query, at).collect())


def values(engine, query, at):
    return [v for _, v in run(engine, query, at)]


# Queries and expected numbers are the published cases of the dialect.
GET = 'http_requests_total{method="GET"}'


@pytest.mark.parametrize(
    "query, at, expected",
    [
        ("rate(http_requests_total[5m])", 600, [1.0, 0.5]),
        (f"increase({GET}[5m])", 600, [300.0]),
        ("quantile(0.5, http_requests_total)", 600, [450.0]),
        ("stdvar(http_requests_total)", 600, [22500.0]),
        ("stddev(http_requests_total)", 600, [150.0]),
        ("count_over_time(boundary_metric[3m])", 180, [3.0]),
        (f"avg_over_time({GET}[5m])", 600, [480.0]),
        ("delta(reset_metric[3m])", 180, [4.5]),
        ("idelta(reset_metric[4m])", 180, [5.0]),
        ("changes(reset_metric[3m])", 180, [2.0]),
        ("resets(reset_metric[3m])", 180, [1.0]),
        ("stdvar_over_time(reset_metric[3m])", 180, [38 / 9]),
        ("quantile_over_time(0.5, reset_metric[3m])", 180, [4.0]),
        ("deriv(gauge_metric[3m])", 180, [2.0]),
        ("mad_over_time(reset_metric[3m])", 180, [2.0]),
        ("predict_linear(gauge_metric[3m], 60)", 180, [480.0]),
        ("holt_winters(gauge_metric[4m], 0.5, 0.5)", 180, [480.0]),
        ('histogram_quantile(0.9, request_duration_seconds_bucket{instance="a"})', 60, [1.0]),
        ("histogram_quantile(0.5, sum by (job, le) (request_duration_seconds_bucket))", 60, [0.5]),
        ("rate(sparse_counter_total[5m])", 600, [0.8]),
        ("increase(sparse_counter_total[5m])", 600, [240.0]),
        ("delta(sparse_gauge[5m])", 600, [240.0]),
        ("left_metric / on(job) group_left(team) right_metric", 60, [2.5, 5.0]),
        ("quantile(0.5, nan_metric)", 60, [1.0]),
        ("topk(1, nan_metric)", 60, [2.0]),
        ("bottomk(1, nan_metric)", 60, [1.0]),
        ("min(nan_metric)", 60, [1.0]),
        ("max(nan_metric)", 60, [2.0]),
        ("stale_metric", 130, []),
        ("count_over_time(stale_metric[5m])", 130, [2.0]),
        ("revived_metric", 100, []),
        ("revived_metric", 130, [7.0]),
        ("future_metric offset -1m", 600, [7.0]),
        ("-2 ^ 2 + 0 * vector(1)", 60, [4.0]),
        ("sgn(vector(0))", 60, [1.0]),
        ("left_metric and on(job) right_metric", 60, [5.0, 10.0]),
        ("left_metric unless on(job) right_metric", 60, []),
        ("left_metric or right_metric", 60, [5.0, 10.0, 2.0]),
        ("left_metric > 5", 60, [10.0]),
        ("left_metric > bool 5", 60, [0.0, 1.0]),
        ("count(left_metric)", 60, [2.0]),
        ("scalar(right_metric) + left_metric", 60, [7.0, 12.0]),
        ("count_scalar(nothing) + left_metric", 60, [5.0, 10.0]),
        ("absent(nothing)", 60, [1.0]),
        ("absent(left_metric)", 60, []),
        ("absent_over_time(nothing[5m])", 60, [1.0]),
        ("clamp(left_metric, 6, 8)", 60, [6.0, 8.0]),
        ("round(vector(2.5))", 60, [3.0]),
        ("floor(vector(2.5))", 60, [2.0]),
        ("timestamp(left_metric)", 90, [60.0, 60.0]),
        ("time() + vector(0)", 90, [90.0]),
        ("hour(vector(7200))", 60, [2.0]),
        ("days_in_month(vector(0))", 60, [31.0]),
        (f"max_over_time({GET}[5m:2m])", 600, [540.0]),
        (f"sum_over_time({GET}[5m:2m])", 600, [1260.0]),
        ("limitk(1, left_metric) * 0", 60, [0.0]),
        ("limit_ratio(1, left_metric)", 60, [5.0, 10.0]),
        ("sum(left_metric) by (job)", 60, [15.0]),
        ("vector(1) / 0", 60, [math.inf]),
        ("vector(-7) % 3", 60, [-1.0]),
        ("ln(vector(0))", 60, [-math.inf]),
        ("last_over_time(boundary_metric[3m])", 180, [4.0]),
    ],
)
def test_values(engine, query, at, expected):
    assert sorted(values(engine, query, at)) == pytest.approx(sorted(expected))


def test_nan_results(engine):
    assert math.isnan(values(engine, "histogram_quantile(0.9, incomplete_duration_seconds_bucket)", 60)[0])
    assert math.isnan(values(engine, "scalar(left_metric) + vector(1)", 60)[0])


def test_labels(engine):
    assert run(engine, 'count_values("current", http_requests_total)', 600) == [((("current", "300"),), 1.0), ((("current", "600"),), 1.0)]
    got = run(engine, "left_metric / on(job) group_left(team) right_metric", 60)
    assert all(("team", "core") in labels for labels, _ in got)
    got = run(engine, 'label_replace(up, "dst", "srv$1", "job", "(.*)")', 600)
    assert ("dst", "srvapi") in got[0][0]
    got = run(engine, 'label_join(up, "both", "-", "job", "instance")', 600)
    assert ("both", "api-a") in got[0][0]
    got = run(engine, "info(up)", 600)
    assert ("k8s_cluster_name", "prod") in got[0][0] and ("team", "platform") in got[0][0]
    got = run(engine, 'info(up, {__name__=~".+_info", build_version=~".+"})', 600)
    assert ("build_version", "1.2.3") in got[0][0] and len(got[0][0]) == 3
    assert run(engine, 'absent(nothing{job="x",a!="b"})', 60)[0][0] == (("job", "x"),)
    assert [labels for labels, _ in run(engine, "drop_common_labels(left_metric)", 60)] == [(("instance", "a"),), (("instance", "b"),)]


def test_range_query(engine):
    rows = engine.range("GETS @ start()".replace("GETS", GET), 300, 600, 60).collect()
    assert sorted(r.ts for r in rows) == list(range(300, 601, 60)) and {r.value for r in rows} == {300.0}
    rows = engine.range(f"rate({GET}[5m])", 300, 600, 60).collect()
    assert len(rows) == 6 and all(r.value == pytest.approx(1.0) for r in rows)
    rows = engine.range(f"sum_over_time({GET}[2m:1m])", 300, 420, 60).orderBy("ts").collect()
    assert [(r.ts, r.value) for r in rows] == [(300, 720.0), (360, 900.0), (420, 1080.0)]
    rows = engine.range(f"max_over_time({GET}[2m:50s])", 300, 400, 10).orderBy("ts").collect()
    assert rows[0].value == 240.0 and len(rows) == 11


def test_exact_series_hides_supersets(spark):
    df = samples(spark, ("m", {"job": "a"}, [(60, 1)]), ("m", {"job": "a", "x": "y"}, [(60, 2)]))
    e = Engine(df, units=1)
    assert values(e, 'm{job="a"}', 60) == [1.0]
    assert sorted(values(e, 'm{job=~"a"}', 60)) == [1.0, 2.0]
    assert values(e, 'm{job="a"}', 10_000) == []


def test_errors(engine):
    for query, error in [
        ("sum(", ParseError),
        ("rate(up)", TypeMismatch),
        ("rate(up[5m]) offset 1h", TypeMismatch),
        ("nope(up)", UnknownFunction),
        ("SUM(up)", UnknownFunction),
        ("abs()", ArgumentCount),
        ("1 == 2", TypeMismatch),
        ("{}", ParseError),
        ('{a=""}', ParseError),
        ("1e3", ParseError),
        ("a and group_left b", ParseError),
        ("compare_left * on(job) compare_right", EvalError),
        ("limit_ratio(2, up)", EvalError),
    ]:
        with pytest.raises(error):
            engine.instant(query, 60 if "compare" in query else 600).collect()


def test_variance_is_not_gathered(spark):
    """A window's variance comes from partial results, not from its points in one row; large values keep theirs."""
    points = [(t, 1e200) for t in range(1, 5)]
    df = samples(spark, ("m", {"k": "same"}, points), ("m", {"k": "nan"}, [(1, 1.0), (2, float("nan"))]), ("m", {"k": "inf"}, [(1, float("inf"))]), ("m", {"k": "far"}, [(1, 1e150), (2, -1e150)]))
    engine = Engine(df.repartition(3), units=1)
    got = engine.instant("stddev_over_time(m[10s])", 9)
    assert "collect_list" not in got._jdf.queryExecution().analyzed().toString()
    by = {r.labels[0].value: r.value for r in got.collect()}
    assert by["same"] == 0.0 and math.isnan(by["nan"]) and math.isnan(by["inf"]) and by["far"] == pytest.approx(1e150)
    # windows that overlap
    assert [r.value for r in engine.range('stdvar_over_time(m{k="same"}[4s])', 4, 8, 2).orderBy("ts").collect()] == [0.0, 0.0]


def test_mad_of_a_long_window(spark):
    """The median that deviations are taken from is computed once a window, not once a point."""
    df = samples(spark, ("m", {}, [(t, (t * 7919) % 4001) for t in range(1, 4002)])).cache()
    df.count()
    began = time.monotonic()
    # values 0..4000 in some order: median 2000, deviations 0, 1, 1, 2, 2, ...
    assert [r.value for r in Engine(df, units=1).instant("mad_over_time(m[9000s])", 5000).collect()] == [1000.0]
    assert time.monotonic() - began < 20
