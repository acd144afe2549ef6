import math
import struct

import pytest
from pyspark.sql import functions as F

from tests.fixtures import samples
from tidemark.errors import InvalidRequest, UnsupportedAggregation
from tidemark.model import LABELS, value_checks
from tidemark.operators import aggregations as A
from tidemark.operators import catalog as C
from tidemark.operators import select as S


@pytest.fixture(scope="module")
def points(spark):
    nan = float("nan")
    return samples(
        spark,
        ("ds", {}, [(1000, 1), (2000, 2), (3000, 3), (4500, 1)]),
        ("ds_align", {}, [(1100, 1), (5100, 2)]),
        ("agg", {}, [(100, 1), (200, 2), (300, 3.5)]),
        ("page", {}, [(1000 * (i + 1), i) for i in range(5)]),
        ("nans", {}, [(1000, nan), (2000, 3), (3000, 1.5)]),
        ("median", {}, [(1000, 10), (2000, nan), (3000, 30), (4000, 20)]),
        ("special", {}, [(100, nan), (200, math.inf), (300, -math.inf), (400, 0.0), (500, -0.0)]),
        ("duplicates", {}, [(100, 1), (100, 2), (100, 3), (200, 4)]),
        ("extreme", {}, [(-(1 << 63) + 1, 1), (1, 2), ((1 << 63) - 2, 3)]),
        ("requests", {}, [(1000, 100), (2000, 110)]),
        ("requests", {"endpoint": "/api/core"}, [(1500, 150)]),
    ).cache()


def rows(df):
    return [(r.ts, r.value) for r in df.collect()]


def test_select(points):
    assert rows(S.select(points, "requests", {}, 0, 9000)) == [(1000, 100.0), (2000, 110.0)]
    assert rows(S.select(points, "requests", {"endpoint": "/api/core"}, 0, 9000)) == [(1500, 150.0)]
    assert rows(S.select(points, "nothing")) == []
    assert rows(S.select(points, "duplicates", None, 100, 200)) == [(100, 1.0), (100, 2.0), (100, 3.0)]
    assert [t for t, _ in rows(S.select(points, "extreme"))] == [-(1 << 63) + 1, 1, (1 << 63) - 2]
    with pytest.raises(InvalidRequest):
        S.select(points, "ds", None, 5, 5)


def test_downsample(points):
    run = lambda m, **o: rows(S.select_with_options(points, m, S.Options(**o)))
    assert run("ds", start=1000, end=5000, interval=2000, aggregation="avg") == [(1000, 1.5), (3000, 2.0)]
    assert run("ds", start=1000, end=5000, interval=2000) == [(1000, 2.0), (3000, 1.0)]
    assert run("ds_align", start=1000, end=6000, interval=2000, aggregation="sum") == [(1000, 1.0), (5000, 2.0)]
    assert run("page", limit=2, offset=1) == [(2000, 1.0), (3000, 2.0)] and run("page", limit=0) == []
    assert run("median", aggregation="median") == [(4000, 20.0)] and run("median", aggregation="count") == [(4000, 3)]
    assert run("nans", aggregation="sum") == [(3000, 4.5)] and run("nans", aggregation="min") == [(3000, 1.5)] and run("nans", aggregation="max") == [(2000, 3.0)]
    assert math.isnan(run("nans", aggregation="first")[0][1])
    assert run("agg", aggregation="variance") == [(300, pytest.approx(1.0555555555555556))]
    assert run("special", aggregation="max") == [(200, math.inf)]
    with pytest.raises(InvalidRequest):
        run("ds", start=0, end=10, interval=0)
    assert struct.pack("d", run("special", aggregation="last")[0][1]) == struct.pack("d", -0.0)


def test_typed_values(spark):
    base = [("m", [], i, i) for i in range(3)]
    ints = spark.createDataFrame([(*b, v) for b, v in zip(base, [(1 << 62), (1 << 62), (1 << 62)], strict=True)], f"metric string, labels {LABELS}, ts long, seq long, value long")
    assert rows(A.whole(ints, "sum")) == [(2, (1 << 63) - 1)]
    assert rows(A.whole(ints, "range")) == [(2, 0)]
    texts = ints.withColumn("value", F.lit("a"))
    assert rows(A.whole(texts, "count")) == [(2, 3)] and rows(A.whole(texts, "max")) == [(0, "a")]
    with pytest.raises(UnsupportedAggregation):
        A.whole(texts, "sum")
    raw = ints.withColumn("value", F.col("ts").cast("string").cast("binary"))
    out = A.custom(raw, lambda b: int(b.decode()), sum, lambda n: str(n).encode())
    assert [bytes(r.value) for r in out.collect()] == [b"3"]
    out = A.custom(raw, lambda b: int(b.decode()), max, lambda n: str(n).encode(), interval=2)
    assert sorted((r.ts, bytes(r.value)) for r in out.collect()) == [(0, b"1"), (2, b"2")]


def test_many_series_shards(spark, points):
    got = S.select_many(points, [("page", {}), ("none", {}), ("requests", {"endpoint": "/api/core"})], 0, 3000).collect()
    assert [(r.ordinal, len(r.points)) for r in got] == [(0, 2), (1, 0), (2, 1)]
    names = [(r.metric, len(r.labels)) for r in S.select_series(points, None, (S.Matcher("endpoint", "!=", ""),)).collect()]
    assert names == [("requests", 1)]
    with pytest.raises(InvalidRequest):
        S.select_series(points, start=1)
    digest = {r.shard: r.fingerprint for r in S.shard_digest(points, 4, 0, 10_000).collect()}
    again = {r.shard: r.fingerprint for r in S.shard_digest(points.orderBy(F.desc("ts")), 4, 0, 10_000).collect()}
    assert digest == again
    total = sum(S.in_shards(points, 4, [k]).count() for k in range(4))
    assert total == points.count()
    page, after = S.scan_rows(points, 0, 10_000, limit=7)
    rest, end = S.scan_rows(points, 0, 10_000, limit=1000, offset=after)
    assert page.count() == 7 and end is None and rest.count() == points.where("ts >= 0 and ts < 10000").count() - 7


def test_deletes_retention_tenants(spark, points):
    empty = spark.createDataFrame([], C.EMPTY_TOMBSTONES)
    page = S.select_series(points, "page")
    stones, matched, changed = C.tombstone(empty, page, 1000, 3000)
    assert (matched, changed) == (1, 1)
    stones, matched, changed = C.tombstone(stones, page, 1500, 2000)
    assert (matched, changed) == (1, 0)
    stones, _, changed = C.tombstone(stones, page, 3000, 3500)
    assert changed == 1 and [(r.start, r.end) for r in stones.collect()] == [(1000, 3500)]
    left = C.without_deleted(points, stones)
    assert rows(S.select(left, "page")) == [(4000, 3.0), (5000, 4.0)] and left.where("metric = 'ds'").count() == 4
    assert C.retention_reference(points.where("metric = 'page'"), 3000, 1000, 1) == 4000
    assert rows(S.select(C.retained(points, 5000, 1000), "page")) == [(4000, 3.0), (5000, 4.0)]
    own = C.stamped(points.where("metric = 'page'"), "a")
    both = own.unionByName(points.where("metric = 'agg'"))
    assert C.scoped(both, "a").where("size(labels) = 0").count() == 5 and C.scoped(both, C.DEFAULT_TENANT).count() == 3 and C.scoped(both, "b").count() == 0
    assert C.tiers(5, 10, 3) == ["hot", "warm"] and C.tiers(None, 10, 3) == ["hot", "warm", "cold"] and C.tiers(10, 10, 3) == ["hot"]
    assert C.range_points(0, 10, 3) == 4


def test_metadata_exemplars(spark, points, tmp_path):
    meta = spark.createDataFrame([("default", "f", "counter", "old", "s", 1), ("default", "f", "gauge", "new", "s", 2), ("x", "g", "gauge", "", "", 1)], "tenant string, family string, type string, help string, unit string, updated long")
    assert [tuple(r) for r in C.metadata(meta).collect()] == [("f", "gauge", "new", "s")]
    ex = points.where("metric = 'page'").select("metric", "labels", F.col("labels").alias("exemplar_labels"), "ts", "value", "seq")
    kept = C.keep_exemplars(ex.union(ex.withColumn("seq", F.col("seq") + 100).withColumn("value", F.col("value") + 10)), per_series=3)
    assert sorted((r.ts, r.value) for r in kept.collect()) == [(3000, 12.0), (4000, 13.0), (5000, 14.0)]
    from tidemark.plans.compiler import Engine

    assert C.query_exemplars(kept, Engine(points), "rate(page[5m]) + nothing", 3000, 4000).count() == 2
    with pytest.raises(InvalidRequest):
        C.query_exemplars(kept, Engine(points), "page", 0, 1, limit=5000)
    C.dump(points, str(tmp_path / "snap"), 1000)
    assert C.load(spark, str(tmp_path / "snap")).count() == points.count()


def test_ingest_checks(spark):
    df = spark.createDataFrame([("", []), ("m", [("", "x")]), ("m", [("a", "1"), ("a", "2")]), ("m", [("a" * 300, "1")]), ("m", [("a", "")])], f"metric string, labels {LABELS}")
    assert [r[0] for r in df.select(value_checks(df)).collect()] == ["empty metric", "empty label name", "duplicate label", "label name too long", None]


def test_merge_of_any_size(spark, points, monkeypatch):
    """A merge is whole however many points it has, unless the caller sets limits."""
    for name in ("MERGE_SERIES", "MERGE_POINTS", "MERGE_TOTAL"):
        monkeypatch.setattr(C, name, 1)
    assert C.merge_replicas([points, points]).count() == points.dropDuplicates(["metric", "labels", "ts", "value"]).count() > 1
    assert C.merge_replicas([points, points], max_total=1000).count() > 1
    for limit in ("max_series", "max_points", "max_total"):
        with pytest.raises(InvalidRequest):
            C.merge_replicas([points, points], **{limit: 1})


def test_custom_streams_its_values(spark):
    """The values of a group come in time order over many batches, and are no list of decoded ones."""
    n = 25_000
    df = spark.range(n).select(F.lit("m").alias("metric"), F.array().cast(LABELS).alias("labels"), ((F.col("id") * 7919) % n).alias("ts"), F.col("id").alias("seq"))
    df = df.withColumn("value", F.col("ts").cast("string").cast("binary")).repartition(5)

    def combine(xs):
        assert not isinstance(xs, list) and len(xs) == n and xs[-1] == n - 1 and xs[3:5] == [3, 4]
        return all(a == i for i, a in enumerate(xs))

    got = A.custom(df, lambda b: int(b.decode()), combine, lambda x: str(x).encode()).collect()
    assert [(r.ts, bytes(r.value)) for r in got] == [(n - 1, b"True")]
