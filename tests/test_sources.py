import math
import struct

import pytest

from tidemark.sources import text as T
from tidemark.sources import wire as W


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_exposition(spark):
    df = lines(spark, "# HELP x", "", "a 1", 'b{x="}{",y="q\\"\\n"} 2.5 99 # {trace="t"} 0.5 98', None)
    got = sorted((r.metric, [tuple(x) for x in r.labels], r.ts, r.value) for r in T.read(df, "exposition", default_ts=7).collect())
    assert got == [("a", [], 7, 1.0), ("b", [("x", "}{"), ("y", 'q"\n')], 99, 2.5)]
    ex = T.read_exemplars(df).collect()
    assert [(r.metric, r.ts, r.value, [tuple(x) for x in r.exemplar_labels]) for r in ex] == [("b", 98, 0.5, [("trace", "t")])]
    for bad in ("1a 2", "a{x=1} 2", "a{x=\"1\",x=\"2\"} 3", "a", "a b"):
        with pytest.raises(T.BadLine):
            T.exposition(bad, 0)
    assert T.read(lines(spark, "a 1", "a b"), "exposition", strict=False).count() == 1


def test_line_protocols(spark):
    assert T.measurement(r"cpu\ load,host=a\,b value=1,idle=2i,used=3u 5000000", 0) == [("cpu_load", [("host", "a,b")], 5, 1.0), ("cpu_load_idle", [("host", "a,b")], 5, 2.0), ("cpu_load_used", [("host", "a,b")], 5, 3.0)]
    assert T.measurement("m v=1 2", 0, precision="s")[0][2] == 2000
    for bad in ('m v="x"', "m v=true", "m", "m v=1 2 3", "m v=1_0"):
        with pytest.raises(T.BadLine):
            T.measurement(bad, 0)
    assert T.graphite("a.b-c;env=prod 1.5 10", 0) == [("a_b_c", [("env", "prod")], 10_000, 1.5)]
    with pytest.raises(T.BadLine):
        T.graphite("a nan 1", 0)
    assert T.identifier("9a.b:c") == "_9a_b_c" and T.identifier("a:b", metric=True) == "a:b" and T.identifier("é") == "_xC3__xA9_"
    row = '{"metric":{"__name__":"m","a":"b"},"values":[1,2.5],"timestamps":[10,20]}'
    assert T.ndjson(row, 0) == [("m", [("a", "b")], 10, 1.0), ("m", [("a", "b")], 20, 2.5)]
    left = T.read(lines(spark, row), "ndjson")
    assert T.compare(left, left).count() == 0 and T.compare(left, left.where("ts = 10")).count() == 1


def test_statsd(spark):
    df = spark.createDataFrame([("hits:2|c|@0.5|#a:b,c", 1, 0), ("g:5|g", 1, 1), ("g:+3|g", 2, 2), ("g:-1|g", 3, 3), ("g:2|g", 4, 4), ("g:+1|g", 5, 5), ("t:7|ms|@0.1", 1, 6), ("u:bob|s", 1, 7)], "value string, ts long, seq long")
    got = {(r.metric, r.ts): r for r in T.statsd(df).collect()}
    assert got["hits", 1].value == 4.0 and [tuple(x) for x in got["hits", 1].labels] == [("a", "b"), ("c", "true")]
    assert [got["g", t].value for t in (1, 2, 3, 4, 5)] == [5.0, 8.0, 7.0, 2.0, 3.0]
    assert ("statsd_sample_rate", "0.1") in [tuple(x) for x in got["t", 1].labels] and ("statsd_set_member", "bob") in [tuple(x) for x in got["u", 1].labels]


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def field(k, value):
    if isinstance(value, float):
        return varint(k << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, int):
        return varint(k << 3) + varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return varint(k << 3 | 2) + varint(len(raw)) + raw


def fixed(k, n):
    return varint(k << 3 | 1) + n.to_bytes(8, "little")


def label(n, v):
    return field(1, field(1, n) + field(2, v))


def test_remote_write(spark):
    hist = field(1, 10) + field(3, 7.0) + field(4, 0) + field(5, 0.5) + field(6, 2) + field(11, field(1, 1) + field(2, 2)) + field(12, varint(6) + varint(4)) + field(15, 60_000)
    series = label("__name__", "m") + label("a", "b") + field(2, field(1, 1.5) + field(2, 1000)) + field(2, varint(1 << 3 | 1) + W.STALE_BITS.to_bytes(8, "little") + field(2, 2000)) + field(4, hist) + field(3, label("t", "x") + field(2, 0.5) + field(3, 900))
    payload = field(1, series) + field(3, field(1, 1) + field(2, "m") + field(4, "help"))
    got = W.write_request(payload)
    assert [(r[0], r[2], r[4]) for r in got["samples"]] == [("m", 1000, False), ("m", 2000, True), ("m", 60_000, False)]
    h = got["samples"][2][5]
    assert h["positive_counts"] == [3.0, 5.0] and h["positive_spans"] == [{"offset": -1, "length": 2}] and h["count"] == 10.0
    assert got["exemplars"] == [("m", [("a", "b")], [("t", "x")], 900, 0.5)] and got["metadata"] == [("m", 1, "help", "")]
    block = varint(len(payload)) + bytes([60 << 2]) + bytes([len(payload) - 1]) + payload
    df = spark.createDataFrame([(block,)], "content binary")
    rows = W.read_remote_write(df).orderBy("ts").collect()
    assert len(rows) == 3 and rows[2].hist.positive_counts == [3.0, 5.0] and math.isnan(rows[2].value)
    with pytest.raises(W.BadPayload):
        W.write_request(field(1, label("a", "b")))
    assert W.unsnappy(bytes([8, 0b00001100]) + b"abcd" + bytes([0b00000001, 4])) == b"abcdabcd"


def test_otlp(spark):
    attr = lambda k, n, v: field(k, field(1, n) + field(2, v))
    point = attr(7, "a_b", field(1, "x")) + fixed(3, 1_000_000_000) + field(4, 2.5)
    gauge = field(1, "my.gauge") + field(5, field(1, point))
    total = field(1, "t") + field(7, field(1, fixed(3, 10**9) + fixed(6, 3)) + field(2, 2))
    bars = field(1, "h") + field(9, field(1, fixed(3, 10**9) + fixed(4, 3) + field(5, 4.5) + field(6, struct.pack("<3Q", 1, 1, 1)) + field(7, struct.pack("<2d", 0.5, 2.0))) + field(2, 2))
    body = lambda *ms: field(1, field(1, attr(1, "svc", field(1, "api"))) + field(2, b"".join(field(2, m) for m in ms)))
    got = {(m, tuple(v for n, v in ls if n in ("le", "quantile"))): (dict(ls), ts, x) for m, ls, ts, x in W.otlp_request(body(gauge, total, bars))}
    labels, ts, x = got["my_x2E_gauge", ()]
    assert (ts, x) == (1000, 2.5) and labels == {"resource_svc": "api", "otel_metric_kind": "gauge", "a__b": "x"}
    assert got["t", ()][0]["otel_monotonic"] == "false" and got["t", ()][2] == 3.0
    assert [got["h_bucket", (le,)][2] for le in ("0.5", "2", "+Inf")] == [1.0, 2.0, 3.0] and got["h_sum", ()][2] == 4.5 and got["h_count", ()][2] == 3.0
    for bad in (field(1, "t") + field(7, field(1, point) + field(2, 1)), field(1, "e") + field(10, b""), field(1, "z") + field(5, field(1, field(4, 1.0)))):
        with pytest.raises(W.BadPayload):
            W.otlp_request(body(bad))
    assert W.read_otlp(spark.createDataFrame([(body(gauge),)], "content binary")).count() == 1


def test_bodies_are_read_one_by_one(spark, monkeypatch):
    """Samples of one body at a time are held, so a frame is no larger than a body."""
    made = []

    class Pandas:
        DataFrame = staticmethod(lambda rows, columns: made.append(len(rows)))

    class Payloads:
        sparkSession = spark
        select = lambda self, *c: self

        def mapInPandas(self, run, schema):
            list(run(iter([{"b": [b"1", b"2", b"3"]}])))
            return spark.range(0).selectExpr("double(id) value")

    monkeypatch.setattr(W, "pd", Pandas)
    monkeypatch.setattr(W, "write_request", lambda b, units: {"samples": [0] * int(b)})
    monkeypatch.setattr(W, "otlp_request", lambda b, units: [0] * int(b))
    W.read_remote_write(Payloads(), compressed=False)
    W.read_otlp(Payloads())
    assert made == [1, 2, 3, 1, 2, 3]
