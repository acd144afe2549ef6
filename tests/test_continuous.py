"""Rollups, rules, native histograms, streaming, session."""

import pytest
from pyspark.sql import functions as F

from tests.fixtures import samples
from tidemark.errors import EvalError, InvalidRequest
from tidemark.model import HIST, LABELS
from tidemark.plans.compiler import Engine
from tidemark.streaming import gauges, rollups, rules


def test_rollups(spark, tmp_path):
    df = samples(spark, ("m", {"a": "1"}, [(t, t) for t in range(0, 100, 5)]), ("m", {"a": "2"}, [(0, 1), (25, 2)]))
    p = rollups.Policy("p", "m", 10, "sum")
    store = rollups.Store(spark, str(tmp_path / "r"))
    store.run(df.where("ts < 57"), p)
    first = sorted((r.labels[0].value, r.ts, r.value) for r in store.read(p).collect())
    assert first == [("1", t, float(2 * t + 5)) for t in range(0, 50, 10)] + [("2", 0, 1.0)]
    store.run(df, p)
    assert store.read(p).count() == 10 and store.read(p).select("labels", "ts").distinct().count() == 10
    got, used = store.downsample(df, [p], "m", {"a": "1"}, 0, 95, 10, "sum")
    assert used == "p" and [(r.ts, r.value) for r in got.collect()] == [(t, float(2 * t + 5)) for t in range(0, 90, 10)] + [(90, 90.0)]
    assert store.downsample(df, [p], "m", {"a": "1"}, 5, 95, 10, "sum")[1] is None
    assert store.downsample(df, [p], "m", {"a": "1"}, 0, 95, 10, "avg")[1] is None
    late = samples(spark, ("m", {"a": "1"}, [(3, 1000)]))
    assert store.is_late(late, p) and not store.is_late(samples(spark, ("m", {"a": "1"}, [(200, 1)])), p)
    assert store.rebuild(df.unionByName(late), p) == 1
    assert store.read(p).where("ts = 0 and labels[0].value = '1'").first().value == 1005.0
    with pytest.raises(InvalidRequest):
        rollups.validate([p, p])


def test_rules(spark):
    df = samples(spark, ("up", {"job": "a"}, [(t, 0) for t in range(0, 601, 60)]), ("up", {"job": "b"}, [(0, 0), (60, 1)]))
    e = Engine(df, units=1, lookback_ms=100_000)
    group = rules.Group("g", 60, (rules.Recording("r:up", "sum(up)", {"team": "x"}), rules.Alert("down", "up == 0", for_=120)), {"team": "y", "env": "p"})
    empty = spark.createDataFrame([], rules.STATE)
    rows, state, at = rules.evaluate(e, group, 65, empty)
    assert at == 60
    assert [(r.metric, [tuple(x) for x in r.labels], r.value) for r in rows[0].collect()] == [("r:up", [("env", "p"), ("team", "x")], 1.0)]
    state = spark.createDataFrame(state.collect(), rules.STATE)
    assert [(r.active_since, r.firing) for r in state.collect()] == [(60, False)]
    assert rules.evaluate(e, group, 70, state, at)[0] == []
    _, state, _ = rules.evaluate(e, group, 185, state, at)
    assert [(r.active_since, r.firing) for r in state.collect()] == [(60, True)]
    with pytest.raises(InvalidRequest):
        rules.Group("g", 60, (rules.Recording("x", "1", {"a": ""}),))


def hist(count, total, zero, counts, hint="No"):
    return (float(count), float(total), 0, 0.5, float(zero), [], [], [(-1, 2)], [float(c) for c in counts], hint, [])


@pytest.fixture(scope="module")
def native(spark):
    rows = []
    for i in "ab":
        rows += [("req", [("instance", i), ("job", "api")], 60, len(rows), float("nan"), False, hist(10, 7, 2, [3, 5])), ("req", [("instance", i), ("job", "api")], 120, len(rows) + 1, float("nan"), False, hist(20, 15, 4, [6, 10]))]
    rows += [("mixed", [("kind", "float")], 120, 90, 3.0, False, None), ("mixed", [("kind", "hist")], 120, 91, float("nan"), False, hist(5, 3.5, 1, [1.5, 2.5]))]
    return Engine(spark.createDataFrame(rows, f"metric string, labels {LABELS}, ts long, seq long, value double, is_stale boolean, hist {HIST}"), units=1)


def test_native_histograms(native):
    got = native.instant('increase(req{instance="a"}[2m])', 120).collect()[0].hist
    assert (got["count"], got["sum"], got["positive_counts"]) == (20.0, 16.0, [6.0, 10.0])
    got = native.instant("sum(req)", 120).collect()[0].hist
    assert got["count"] == 40.0 and got["positive_counts"] == [12.0, 20.0]
    got = native.instant("avg(req)", 120).collect()[0].hist
    assert got["count"] == 20.0
    assert sorted(r.value for r in native.instant("histogram_count(req)", 120).collect()) == [20.0, 20.0]
    assert native.instant("histogram_avg(req)", 120).collect()[0].value == 0.75
    q = native.instant("histogram_quantile(0.5, req)", 120).collect()
    assert all(0 < r.value <= 2 for r in q) and len(q) == 2
    for query in ("sum(mixed)", "req + req", "histogram_stddev(req)", "scalar(req{instance='a'})".replace("'", '"'), "delta(req[2m])", "abs(req)"):
        with pytest.raises(EvalError):
            native.instant(query, 120)
    assert native.instant("histogram_fraction(0, 1, vector(1))", 120).count() == 0
    assert native.instant("count(mixed)", 120).collect()[0].value == 2.0


def test_streaming_rollup(spark, tmp_path):
    df = samples(spark, ("m", {}, [(t, 1) for t in range(0, 10_000_000, 250_000)]))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = rollups.stream(source, rollups.Policy("p", "m", 1_000_000, "count"), delay="1 second")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.ts, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert len(got) >= 8 and all(v == 4 for _, v in got)


def test_streaming_gauges(spark, tmp_path):
    rows = [("g", [], 1, 5.0, False, 0), ("g", [], 2, 3.0, True, 1), ("g", [], 3, -1.0, True, 2)]
    df = spark.createDataFrame(rows, f"metric string, labels {LABELS}, ts long, value double, relative boolean, seq long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = gauges.gauges(source).writeStream.format("memory").queryName("gauge_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.value for r in spark.table("gauge_out").orderBy("ts").collect()] == [5.0, 8.0, 7.0]


def test_guards_survive_pruning(spark):
    e = Engine(samples(spark, ("a", {"x": "1"}, [(0, 1)]), ("b", {"x": "1", "y": "1"}, [(0, 1)]), ("b", {"x": "1", "y": "2"}, [(0, 1)])), units=1)
    with pytest.raises(EvalError):
        e.instant("(a * on(x) b) > 100", 0)
    assert e.instant("a * on(x) group_right() b", 0).agg(F.sum("value")).first()[0] == 2.0
