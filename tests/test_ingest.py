import pytest
from pyspark.sql import functions as F

from tests.fixtures import samples
from tidemark.errors import InvalidRequest
from tidemark.operators import histogram as H
from tidemark.operators import select as S
from tidemark.operators.ingest import SampleTable
from tidemark.plans.compiler import Engine


def test_batches_are_atomic(spark, tmp_path):
    table = SampleTable(spark, f"file://{tmp_path}/t", retention=100)
    assert table.read().count() == 0
    one = samples(spark, ("m", {"a": "1"}, [(1, 1), (2, 2)]))
    assert table.insert_rows(one).rows == 2
    with pytest.raises(InvalidRequest, match="empty metric"):
        table.insert_rows(one.unionByName(samples(spark, ("", {}, [(3, 3)]))))
    with pytest.raises(InvalidRequest, match="retention"):
        table.insert_rows(one, now=102)
    assert table.insert_rows(one.drop("seq", "is_stale"), now=101).acknowledged == "durable"
    assert table.read().count() == 4 and table.read(2).count() == 2


def test_a_second_writer_fails(spark, tmp_path):
    table = SampleTable(spark, f"file://{tmp_path}/t")
    rows = samples(spark, ("m", {}, [(1, 1)]))
    before = table.manifest()
    table.insert_rows(rows)
    with pytest.raises(InvalidRequest, match="another writer"):
        table._publish(before)
    assert table.read().count() == 1


def test_tiers_and_deletes(spark, tmp_path):
    table = SampleTable(spark, f"file://{tmp_path}/t")
    table.age(hot_from=5, warm_from=2)
    table.insert_rows(samples(spark, ("m", {}, [(t, t) for t in range(10)])))
    table.age(hot_from=5, warm_from=2)
    manifest = table.manifest()
    assert [spark.read.parquet(*[f"{table.path}/{n}" for n in manifest[t]]).count() for t in ("hot", "warm", "cold")] == [5, 3, 2]
    bounds = {"hot_from": 5, "warm_from": 2}
    assert sorted(r.ts for r in table.read(6, **bounds).collect()) == [6, 7, 8, 9]
    assert table.read(0, **bounds).count() == 10
    assert table.delete_series(S.select_series(table.read(), "m", ()), 3, 7) == (1, 1)
    assert sorted(r.ts for r in table.read().collect()) == [0, 1, 2, 7, 8, 9]


def test_scans(spark):
    df = samples(spark, ("m", {"a": "1"}, [(1, 1), (2, 2)]), ("m", {"a": "2"}, [(1, 3)]), ("n", {}, [(1, 4)]))
    page = S.scan_series_rows(df, [("n", {}), ("m", {"a": "1"}), ("n", {})], 0, 10, limit=2)
    assert [r.value for r in page.rows.collect()] == [4, 1] and page.truncated and page.next_offset == 2
    last = S.scan_series_rows(df, [("n", {}), ("m", {"a": "1"})], 0, 10, limit=2, offset=2)
    assert [r.value for r in last.rows.collect()] == [2] and not last.truncated and last.next_offset is None
    with pytest.raises(InvalidRequest):
        S.scan_series_rows(df, [("n", {}), ("m", {"a": "1"})], 0, 10, limit=2, max_series=1)
    with pytest.raises(InvalidRequest):
        S.scan_metric_rows(df, "m", 0, 10, limit=5, max_series=1)
    assert [r.value for r in S.scan_metric_rows(df, "m", 0, 10, limit=5, max_series=2).rows.collect()] == [1, 2, 3]
    assert sum(S.scan_shard_window_rows(df, 3, k, 0, 10, limit=9).rows.count() for k in range(3)) == 4
    buffer = [0]
    assert S.select_into(buffer, df, "m", {"a": "1"}) == 2 and buffer == [(1, 1.0), (2, 2.0)]


def test_custom_buckets_are_refused(spark):
    from tidemark.model import HIST, finish

    h = (10.0, 7.0, 0, 0.5, 2.0, [], [], [(0, 2)], [3.0, 5.0], "No", [1.0])
    df = finish(spark.createDataFrame([("m", [], 60, float("nan"), h)], f"metric string, labels array<struct<name:string,value:string>>, ts long, value double, hist {HIST}"))
    engine = Engine(df, units=1)
    assert [r.value for r in engine.instant("histogram_count(m)", 60).collect()] == [10.0]
    for query in ("-m", "sum(m) + 0 * sum(m)", "histogram_quantile(0.5, m)", "avg(m)"):
        with pytest.raises(Exception, match="custom buckets|takes no histograms"):
            engine.instant(query, 60).collect()
    two = df.select(H.add(F.col("hist"), F.col("hist")).alias("h"))
    with pytest.raises(Exception, match="custom buckets"):
        two.collect()


def test_subquery_reads_its_samples_once(spark):
    """A subquery whose step is no multiple of the outer one is one scan, and its windows are those of single steps."""
    df = samples(spark, ("m", {}, [(t, t % 97) for t in range(0, 4000, 13)])).coalesce(1)
    engine = Engine(df, units=1)
    query = "max_over_time(sum_over_time(m[200s])[1400s:420s])"
    plan = engine.range(query, 2000, 3800, 60)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LogicalRDD") + text.count("LocalRelation") == 1
    got = {r.ts: r.value for r in plan.collect()}
    for at in range(2000, 3801, 60):
        assert [got[at]] == [r.value for r in engine.instant(query, at).collect()]


def test_overlapping_windows_are_read_by_buckets(spark):
    """Functions over overlapping windows give what they give at single steps, and repeat summaries instead of samples."""
    import math
    import random

    rng = random.Random(7)
    points = [(t, rng.choice([float("nan"), 0.0, 5.0]) if rng.random() < 0.1 else rng.random() * 10) for t in sorted(rng.sample(range(4000), 250))]
    points += [(points[-1][0], 3.0)]
    df = samples(spark, ("m", {"a": "1"}, points), ("m", {"a": "2"}, [(t, t % 500) for t in range(100, 4000, 70)])).coalesce(1).cache()
    engine = Engine(df, units=1)
    calls = ["avg", "sum", "min", "max", "count", "present", "last"]
    for query in [f"{c}_over_time(m[300s] offset 40s)" for c in calls] + [f"{c}(m[450s])" for c in ("rate", "increase", "delta", "changes", "resets")]:
        plan = engine.range(query, 900, 3600, 100)
        assert "_b" in plan._jdf.queryExecution().analyzed().toString()
        got = {(r.labels[0].value, r.ts): r.value for r in plan.collect()}
        for at in (900, 1700, 2500, 3600):
            want = {(r.labels[0].value, at): r.value for r in engine.instant(query, at).collect()}
            assert {k for k in got if k[1] == at} == set(want)
            for k, v in want.items():
                assert got[k] == pytest.approx(v, nan_ok=True) or math.isinf(v) and got[k] == v, (query, k)


def test_migration_stops_at_differences(spark, tmp_path):
    from tidemark.sources import captures

    source = samples(spark, ("m", {"a": "1"}, [(t, t) for t in range(10)]))
    move = captures.Migration(source, SampleTable(spark, f"file://{tmp_path}/t"))
    assert move.backfill(0, 6, 3) == 2 and move.backfill(0, 6, 3) == 0
    assert move.differences(0, 6).count() == 0 and move.differences(0, 10).count() == 4
    with pytest.raises(InvalidRequest, match="not the same"):
        move.cutover(0, 10)
    assert move.backfill(0, 10, 4) == 2 and move.cutover(0, 10).read().count() == 10


def test_captures_of_nothing(spark, tmp_path):
    from tidemark.sources import captures

    (tmp_path / "c.json").write_text('[{"received_at_ms": 5, "body": null}, {"received_at_ms": 7, "query_params": {"precision": "s"}, "body": "m v=1 2\\n\\nm v=2"}]')
    got = captures.read_capture(spark, f"file://{tmp_path}/c.json", "measurement").collect()
    assert sorted((r.metric, r.ts, r.value) for r in got) == [("m_v", 7, 2.0), ("m_v", 2000, 1.0)]
    assert captures.read_capture(spark, f"file://{tmp_path}/c.json", "measurement").count() == 2
    with pytest.raises(InvalidRequest):
        captures.read_capture(spark, f"file://{tmp_path}/c.json", "carbon")


def test_scheduler_runs_a_time_once(spark, tmp_path):
    from tidemark.streaming import rules
    from tidemark.streaming.scheduler import Scheduler

    table = SampleTable(spark, f"file://{tmp_path}/t")
    table.insert_rows(samples(spark, ("m", {"a": "1"}, [(60, 1), (120, 2)])))
    group = rules.Group("g", 60, (rules.Recording("r", "sum(m)"), rules.Alert("hot", "m > 1", for_=0)))
    run = Scheduler(table, (group,), f"file://{tmp_path}/s", units=1)
    assert [run.tick(t) for t in (60, 90, 125)] == [1, 0, 1]
    assert sorted((r.ts, r.value) for r in table.read().where("metric = 'r'").collect()) == [(60, 1.0), (120, 2.0)]
    assert [(r.rule, r.firing) for r in run.state(group).collect()] == [("hot", True)]
