"""Protobuf payloads: remote write and read, and OTLP metrics.

A small reader of the protobuf wire format and of snappy blocks; messages are
dictionaries of field number to the list of raw values.
"""

from __future__ import annotations

import base64
import json
import math
import struct
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import HIST, LABELS
from ..session import ship
from .text import whole


class BadPayload(ValueError):
    pass


def varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise BadPayload("truncated varint")
        x = b[at]
        at += 1
        out |= (x & 127) << shift
        if x < 128:
            return out, at
        shift += 7


def fields(b: bytes) -> dict[int, list]:
    """Field number to raw values: integers, 8- or 4-byte strings, or bytes."""
    out: dict[int, list] = defaultdict(list)
    at = 0
    while at < len(b):
        tag, at = varint(b, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(b, at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = b[at : at + n], at + n
        elif kind == 2:
            n, at = varint(b, at)
            value, at = b[at : at + n], at + n
        else:
            raise BadPayload(f"wire type {kind}")
        if at > len(b):
            raise BadPayload("truncated field")
        out[tag >> 3].append(value)
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def zigzag(x: int) -> int:
    return (x >> 1) ^ -(x & 1)


def double(raw: bytes) -> float:
    return struct.unpack("<d", raw)[0]


def fixed(raw: bytes, sign: bool = False) -> int:
    return int.from_bytes(raw, "little", signed=sign)


def packed(values: list, one) -> list:
    """A repeated scalar, packed or not: ``one`` reads from bytes or takes a single raw value."""
    out = []
    for v in values:
        out += one(v)
    return out


def doubles(values: list) -> list[float]:
    return packed(values, lambda v: [x[0] for x in struct.iter_unpack("<d", v)])


def fixeds(values: list) -> list[int]:
    return packed(values, lambda v: [x[0] for x in struct.iter_unpack("<Q", v)])


def varints(values: list) -> list[int]:
    def one(v):
        if isinstance(v, int):
            return [v]
        out, at = [], 0
        while at < len(v):
            x, at = varint(v, at)
            out.append(x)
        return out

    return packed(values, one)


def text(m: dict[int, list], k: int) -> str:
    return m[k][-1].decode() if m.get(k) else ""


def unsnappy(b: bytes) -> bytes:
    """One snappy block."""
    size, at = varint(b, 0)
    out = bytearray()
    while at < len(b):
        tag = b[at]
        at += 1
        if tag & 3 == 0:
            n = tag >> 2
            if n >= 60:
                k = n - 59
                n, at = int.from_bytes(b[at : at + k], "little"), at + k
            out += b[at : at + n + 1]
            at += n + 1
            continue
        if tag & 3 == 1:
            n, back, at = (tag >> 2 & 7) + 4, (tag >> 5) << 8 | b[at], at + 1
        else:
            k = 2 if tag & 3 == 2 else 4
            n, back, at = (tag >> 2) + 1, int.from_bytes(b[at : at + k], "little"), at + k
        if not 0 < back <= len(out):
            raise BadPayload("bad snappy copy")
        for _ in range(n):
            out.append(out[-back])
    if len(out) != size:
        raise BadPayload("bad snappy length")
    return bytes(out)


# Remote write

I64_MAX = (1 << 63) - 1
HINTS = ("Unknown", "Yes", "No", "Gauge")
STALE_BITS = 0x7FF0000000000002


def _labels(raw: list[bytes]) -> list[tuple[str, str]]:
    pairs = [(text(m, 1), text(m, 2)) for m in map(fields, raw)]
    if len({n for n, _ in pairs}) < len(pairs):
        raise BadPayload("duplicate label")
    return sorted(pairs)


def _spans(raw: list[bytes]) -> list[dict]:
    return [{"offset": zigzag(m[1][-1]) if m.get(1) else 0, "length": m[2][-1] if m.get(2) else 0} for m in map(fields, raw)]


def _counts(deltas: list, counts: list) -> list[float]:
    if deltas and counts:
        raise BadPayload("both deltas and counts")
    out, run = [], 0
    for d in varints(deltas):
        run += zigzag(d)
        out.append(float(run))
    return out or doubles(counts)


def histogram(m: dict[int, list]) -> dict:
    """A native histogram message as the ``hist`` struct, with absolute counts."""
    either = lambda i, f: float(m[i][-1]) if m.get(i) else double(m[f][-1]) if m.get(f) else None
    return {
        "count": either(1, 2),
        "sum": double(m[3][-1]) if m.get(3) else 0.0,
        "schema": zigzag(m[4][-1]) if m.get(4) else 0,
        "zero_threshold": double(m[5][-1]) if m.get(5) else 0.0,
        "zero_count": either(6, 7),
        "negative_spans": _spans(m.get(8, [])),
        "negative_counts": _counts(m.get(9, []), m.get(10, [])),
        "positive_spans": _spans(m.get(11, [])),
        "positive_counts": _counts(m.get(12, []), m.get(13, [])),
        "reset_hint": HINTS[m[14][-1]] if m.get(14) else "Unknown",
        "custom_values": doubles(m.get(16, [])),
    }


def write_request(payload: bytes, units: int = 1000) -> dict[str, list]:
    """``samples``, ``exemplars`` and ``metadata`` rows of an uncompressed WriteRequest."""
    out: dict[str, list] = {"samples": [], "exemplars": [], "metadata": []}
    m = fields(payload)

    def at(raw: int) -> int:
        ms = signed(raw)
        if ms == I64_MAX:
            raise BadPayload("timestamp out of range")
        return ms * units // 1000

    for raw in m.get(1, []):
        s = fields(raw)
        labels = _labels(s.get(1, []))
        name = dict(labels).get("__name__", "")
        if not name:
            raise BadPayload("no __name__")
        own = [x for x in labels if x[0] != "__name__"]
        for p in map(fields, s.get(2, [])):
            bits = p[1][-1] if p.get(1) else b"\0" * 8
            out["samples"].append((name, own, at(p[2][-1] if p.get(2) else 0), double(bits), fixed(bits) == STALE_BITS, None))
        for p in map(fields, s.get(4, [])):
            out["samples"].append((name, own, at(p[15][-1] if p.get(15) else 0), math.nan, False, histogram(p)))
        for p in map(fields, s.get(3, [])):
            out["exemplars"].append((name, own, _labels(p.get(1, [])), at(p[3][-1] if p.get(3) else 0), double(p[2][-1]) if p.get(2) else 0.0))
    for p in map(fields, m.get(3, [])):
        out["metadata"].append((text(p, 2), p[1][-1] if p.get(1) else 0, text(p, 4), text(p, 5)))
    return out


def read_remote_write(payloads: DataFrame, *, col: str = "content", units: int = 1000, compressed: bool = True) -> DataFrame:
    """Samples of remote-write bodies, histograms included (``spark.read.format('binaryFile')`` gives ``content``)."""
    ship(payloads.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            # a frame a body: no more than one body's samples are objects at once
            for b in df["b"]:
                rows = write_request(unsnappy(bytes(b)) if compressed else bytes(b), units)["samples"]
                if rows:
                    yield pd.DataFrame(rows, columns=["metric", "labels", "ts", "value", "is_stale", "hist"])

    return whole(payloads.select(F.col(col).alias("b")).mapInPandas(run, f"metric string, labels {LABELS}, ts long, value double, is_stale boolean, hist {HIST}"))


def remote_read(samples: DataFrame, matchers, start_ms: int, end_ms: int, units: int = 1000) -> DataFrame:
    """(labels with ``__name__``, samples (ts ms, value)) of a read query; the end is inclusive."""
    from ..model import set_label
    from ..operators.select import within

    out = samples
    for m in matchers:
        out = out.where(m.column())
    out = within(out, start_ms * units // 1000, end_ms * units // 1000 + 1).where(F.col("value").isNotNull())
    labels = set_label(F.col("labels"), "__name__", F.col("metric"))
    point = F.struct((F.col("ts") * 1000 / units).cast("long").alias("ts"), "seq", "value")
    rows = out.groupBy(labels.alias("labels")).agg(F.array_sort(F.collect_list(point)).alias("p"))
    return rows.select("labels", F.transform("p", lambda x: F.struct(x["ts"].alias("ts"), x["value"].alias("value"))).alias("samples")).orderBy("labels")


# OTLP

def otlp_identifier(name: str) -> str:
    """``_`` doubled, other bytes that are not letters or digits as ``_xHH_``."""
    return "".join("__" if c == "_" else c if c.isascii() and c.isalnum() else "".join(f"_x{b:02X}_" for b in c.encode()) for c in name)


def any_value(raw: bytes):
    m = fields(raw)
    if m.get(1):
        return m[1][-1].decode()
    if m.get(2):
        return bool(m[2][-1])
    if m.get(3):
        return signed(m[3][-1])
    if m.get(4):
        return double(m[4][-1])
    if m.get(5):
        return [any_value(x) for x in fields(m[5][-1]).get(1, [])]
    if m.get(6):
        return dict(_attributes(fields(m[6][-1]).get(1, [])))
    return b"" if not m.get(7) else m[7][-1]


def _attributes(raw: list[bytes]) -> list[tuple]:
    return [(text(m, 1), any_value(m[2][-1]) if m.get(2) else "") for m in map(fields, raw)]


def attribute_text(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, bytes):
        return "base64:" + base64.b64encode(v).decode()
    if isinstance(v, list | dict):
        return json.dumps(v, separators=(",", ":"), ensure_ascii=False, default=attribute_text)
    if isinstance(v, float):
        from ..functions.ieee import format_number

        return format_number(v)
    return str(v)


def _named(raw: list[bytes], prefix: str) -> list[tuple[str, str]]:
    return [(prefix + otlp_identifier(k), attribute_text(v)) for k, v in _attributes(raw)]


def otlp_request(payload: bytes, units: int = 1000) -> list[tuple]:
    """(metric, labels, ts, value) of an ExportMetricsServiceRequest."""
    out: list[tuple] = []
    for rm in map(fields, fields(payload).get(1, [])):
        resource = _named(fields(rm[1][-1]).get(1, []), "resource_") if rm.get(1) else []
        for sm in map(fields, rm.get(2, [])):
            scope = []
            if sm.get(1):
                s = fields(sm[1][-1])
                scope = [(f"scope_{k}", text(s, i)) for k, i in (("name", 1), ("version", 2)) if text(s, i)] + _named(s.get(3, []), "scope_")
            for metric in map(fields, sm.get(2, [])):
                out += _metric(metric, [*resource, *scope], units)
    return out


def _stamp(p: dict[int, list], flags: int, units: int) -> int:
    ns = fixed(p[3][-1]) if p.get(3) else 0
    if ns == 0:
        raise BadPayload("no timestamp")
    if p.get(flags) and p[flags][-1]:
        raise BadPayload("flagged data point")
    return ns * units // 1_000_000_000


def _metric(m: dict[int, list], base: list[tuple[str, str]], units: int) -> list[tuple]:
    name = otlp_identifier(text(m, 1))
    if m.get(10):
        raise BadPayload("exponential histograms are not taken")
    out: list[tuple] = []

    def put(suffix: str, labels: list[tuple[str, str]], ts: int, value: float) -> None:
        pairs = dict(labels)
        if len(pairs) < len(labels):
            raise BadPayload("duplicate label")
        out.append((name + suffix, sorted(pairs.items()), ts, value))

    cumulative = [("otel_temporality", "cumulative")]
    for key, kind in ((5, "gauge"), (7, "sum"), (9, "histogram"), (11, "summary")):
        for body in map(fields, m.get(key, [])):
            if kind in ("sum", "histogram") and (not body.get(2) or body[2][-1] != 2):
                raise BadPayload("only cumulative temporality is taken")
            own = [*base, ("otel_metric_kind", kind), *(cumulative if kind in ("sum", "histogram") else [])]
            if kind == "sum" and not (body.get(3) and body[3][-1]):
                own.append(("otel_monotonic", "false"))
            for p in map(fields, body.get(1, [])):
                labels = [*own, *_named(p.get(9 if kind == "histogram" else 7, []), "")]
                ts = _stamp(p, 10 if kind == "histogram" else 8, units)
                if kind in ("gauge", "sum"):
                    if not p.get(4) and not p.get(6):
                        raise BadPayload("no value")
                    put("", labels, ts, double(p[4][-1]) if p.get(4) else float(fixed(p[6][-1], True)))
                    continue
                n = fixed(p[4][-1]) if p.get(4) else 0
                if kind == "histogram":
                    counts, bounds = fixeds(p.get(6, [])), doubles(p.get(7, []))
                    if counts and len(counts) != len(bounds) + 1:
                        raise BadPayload("bucket counts and bounds differ")
                    run = 0
                    for bound, c in zip([*bounds, math.inf], counts or [n], strict=bool(counts)):
                        run += c
                        put("_bucket", [*labels, ("le", attribute_text(bound))], ts, float(run))
                    for suffix, k in (("_sum", 5), ("_min", 11), ("_max", 12)):
                        if p.get(k):
                            put(suffix, labels, ts, double(p[k][-1]))
                else:
                    for q in map(fields, p.get(6, [])):
                        put("", [*labels, ("quantile", attribute_text(double(q[1][-1]) if q.get(1) else 0.0))], ts, double(q[2][-1]) if q.get(2) else 0.0)
                    put("_sum", labels, ts, double(p[5][-1]) if p.get(5) else 0.0)
                put("_count", labels, ts, float(n))
    return out


def read_otlp(payloads: DataFrame, *, col: str = "content", units: int = 1000) -> DataFrame:
    ship(payloads.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for b in df["b"]:
                rows = otlp_request(bytes(b), units)
                if rows:
                    yield pd.DataFrame(rows, columns=["metric", "labels", "ts", "value"])

    return whole(payloads.select(F.col(col).alias("b")).mapInPandas(run, f"metric string, labels {LABELS}, ts long, value double"))


# Sinks: request bodies from samples

def put_varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def put(k: int, value) -> bytes:
    """A protobuf field: an integer, a float (8 bytes), a text or bytes."""
    if isinstance(value, float):
        return put_varint(k << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, int):
        return put_varint(k << 3) + put_varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return put_varint(k << 3 | 2) + put_varint(len(raw)) + raw


def snappy_literals(raw: bytes) -> bytes:
    """A snappy block that holds ``raw`` as literals of at most 64 KiB."""
    parts = [put_varint(len(raw))]
    for at in range(0, len(raw), 65_536):
        piece = raw[at : at + 65_536]
        parts += [bytes([61 << 2]), (len(piece) - 1).to_bytes(2, "little"), piece]
    return b"".join(parts)


def _bodies(samples: DataFrame, encode, per: int) -> DataFrame:
    ship(samples.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for at in range(0, len(df), per):
                yield pd.DataFrame({"content": [encode(df.iloc[at : at + per].itertuples(index=False))]})

    return samples.select("metric", "labels", "ts", "value", "is_stale").mapInPandas(run, "content binary")


def write_bodies(samples: DataFrame, *, per: int = 1000, units: int = 1000) -> DataFrame:
    """(content): compressed remote-write bodies of up to ``per`` float samples; stale marks keep their bits."""

    def encode(rows) -> bytes:
        out = []
        for metric, labels, ts, value, stale in rows:
            pairs = [("__name__", metric), *((x["name"], x["value"]) for x in labels)]
            bits = STALE_BITS.to_bytes(8, "little") if stale else struct.pack("<d", value)
            point = put_varint(1 << 3 | 1) + bits + put(2, int(ts) * 1000 // units)
            out.append(put(1, b"".join(put(1, put(1, n) + put(2, v)) for n, v in pairs) + put(2, point)))
        return snappy_literals(b"".join(out))

    return _bodies(samples, encode, per)


def otlp_bodies(samples: DataFrame, *, per: int = 1000, units: int = 1000) -> DataFrame:
    """(content): OTLP metric requests of up to ``per`` gauge points, labels as attributes; stale marks are left out."""

    def encode(rows) -> bytes:
        metrics = []
        for metric, labels, ts, value, stale in rows:
            if stale:
                continue
            attributes = b"".join(put(7, put(1, x["name"]) + put(2, put(1, x["value"]))) for x in labels)
            stamp = put_varint(3 << 3 | 1) + (int(ts) * 1_000_000_000 // units).to_bytes(8, "little")
            metrics.append(put(2, put(1, metric) + put(5, put(1, attributes + stamp + put(4, float(value))))))
        return put(1, put(2, b"".join(metrics)))

    return _bodies(samples, encode, per)
