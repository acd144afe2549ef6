"""Line protocols: exposition text, line protocol with measurements, StatsD, Graphite, NDJSON exports.

Each parser turns one line into rows (metric, labels, ts, value); ``read``
runs it over a frame of lines in Arrow batches. Times are in milliseconds
unless ``units`` says otherwise.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import LABELS
from ..session import ship

Row = tuple[str, list[tuple[str, str]], int, float]
SCHEMA = f"metric string, labels {LABELS}, ts long, value double"


def whole(df: DataFrame) -> DataFrame:
    """NaN crosses from pandas as null; values are never null."""
    return df.withColumn("value", F.coalesce("value", F.lit(math.nan)))


class BadLine(ValueError):
    pass


def identifier(text: str, metric: bool = False) -> str:
    """A valid name: separators become ``_``, other bytes ``_xHH_``, a leading digit gets ``_``."""
    out = []
    for b in text.encode():
        c = chr(b)
        if c.isascii() and c.isalnum() or c == "_" or c == ":" and metric:
            out.append(c)
        elif c in ".-/ :":
            out.append("_")
        else:
            out.append(f"_x{b:02X}_")
    name = "".join(out)
    return "_" + name if name[:1].isdigit() else name


def number(text: str) -> float:
    t = text.strip()
    if not t or "_" in t:
        raise BadLine(f"bad number {text!r}")
    try:
        return float(t)
    except ValueError:
        raise BadLine(f"bad number {text!r}") from None


# Exposition text

_LABEL = re.compile(r'\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"\s*')
_NAME = re.compile(r"\s*([A-Za-z_:][A-Za-z0-9_:]*)\s*")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def _unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text)


def _braced(text: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """Labels from ``{`` at ``at``, and the place after ``}``; values may hold braces."""
    out: list[tuple[str, str]] = []
    at += 1
    while True:
        while text[at : at + 1] in (",", " ", "\t"):
            at += 1
        if text[at : at + 1] == "}":
            return out, at + 1
        m = _LABEL.match(text, at)
        if m is None:
            raise BadLine(f"bad labels in {text!r}")
        out.append((m[1], _unescape(m[2])))
        at = m.end()


def exposition_line(line: str, default_ts: int) -> tuple[Row, tuple | None] | None:
    """(row, exemplar or None); None for blanks and comments. An exemplar is (labels, value, ts or None)."""
    text = line.strip()
    if not text or text.startswith("#"):
        return None
    m = _NAME.match(text)
    if m is None:
        raise BadLine(f"bad name in {line!r}")
    labels, at = _braced(text, m.end()) if text[m.end() : m.end() + 1] == "{" else ([], m.end())
    rest, _, tail = text[at:].partition(" # ")
    fields = rest.split()
    if not 1 <= len(fields) <= 2:
        raise BadLine(f"bad value in {line!r}")
    exemplar = None
    if tail:
        own, k = _braced(tail.strip(), 0)
        parts = tail.strip()[k:].split()
        if not 1 <= len(parts) <= 2:
            raise BadLine(f"bad exemplar in {line!r}")
        exemplar = (own, number(parts[0]), int(number(parts[1])) if len(parts) == 2 else None)
    if len({n for n, _ in labels}) < len(labels):
        raise BadLine(f"repeated label in {line!r}")
    ts = int(fields[1]) if len(fields) == 2 else default_ts
    return (m[1], sorted(labels), ts, number(fields[0])), exemplar


def exposition(line: str, default_ts: int) -> list[Row]:
    found = exposition_line(line, default_ts)
    return [found[0]] if found else []


# Line protocol with measurement, tags, fields

# Precisions in nanoseconds.
PRECISION = {"ns": 1, "u": 1000, "us": 1000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}


def _split(text: str, by: str, quotes: bool = False) -> list[str]:
    """Splits at ``by`` outside escapes (and quotes); escapes stay."""
    out, now, k, quoted = [], "", 0, False
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text):
            now += text[k : k + 2]
            k += 2
            continue
        if c == '"' and quotes:
            quoted = not quoted
        if c == by and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
        k += 1
    return [*out, now]


def _plain(text: str) -> str:
    return re.sub(r"\\([,= \\])", r"\1", text)


def measurement(line: str, default_ts: int, precision: str = "ns", units: int = 1000) -> list[Row]:
    """One row a field: ``value`` keeps the measurement's name, others append theirs."""
    text = line.strip()
    if not text or text.startswith("#"):
        return []
    if precision not in PRECISION:
        raise BadLine(f"unknown precision {precision!r}")
    parts = [p for p in _split(text, " ", quotes=True) if p]
    if not 2 <= len(parts) <= 3:
        raise BadLine(f"bad line {line!r}")
    head = _split(parts[0], ",")
    name, labels = _plain(head[0]), []
    for tag in head[1:]:
        pair = _split(tag, "=")
        if len(pair) != 2 or not pair[0]:
            raise BadLine(f"bad tag {tag!r}")
        labels.append((identifier(_plain(pair[0])), _plain(pair[1])))
    ts = default_ts if len(parts) == 2 else int(parts[2]) * PRECISION[precision] * units // 1_000_000_000
    out = []
    for f in _split(parts[1], ",", quotes=True):
        pair = _split(f, "=", quotes=True)
        if len(pair) != 2:
            raise BadLine(f"bad field {f!r}")
        key, raw = _plain(pair[0]), pair[1]
        if raw.startswith('"') or raw.lower() in ("t", "f", "true", "false"):
            raise BadLine(f"field {key!r} is not a number")
        value = float(int(raw[:-1])) if raw[-1:] in ("i", "u") else number(raw)
        out.append((identifier(name if key == "value" else f"{name}_{key}", metric=True), sorted(labels), ts, value))
    return out


# Graphite

def graphite(line: str, default_ts: int, units: int = 1000) -> list[Row]:
    """``path;k=v... value [seconds]`` with a finite value."""
    text = line.strip()
    if not text:
        return []
    parts = text.split()
    if not 2 <= len(parts) <= 3:
        raise BadLine(f"bad line {line!r}")
    path, *tags = parts[0].split(";")
    labels = []
    for tag in tags:
        k, eq, v = tag.partition("=")
        if not k or not eq:
            raise BadLine(f"bad tag {tag!r}")
        labels.append((identifier(k), v))
    value = number(parts[1])
    if not math.isfinite(value):
        raise BadLine(f"value not finite in {line!r}")
    ts = int(number(parts[2]) * units) if len(parts) == 3 and parts[2] != "-1" else default_ts
    return [(identifier(path, metric=True), sorted(labels), ts, value)]


# StatsD

def statsd_line(line: str) -> list[tuple[str, list[tuple[str, str]], str, float, bool]]:
    """(metric, labels, kind, value, relative): kind c, g, ms, h, d or s."""
    text = line.strip()
    if not text:
        return []
    head, bar, rest = text.partition("|")
    name, colon, raw = head.partition(":")
    if not bar or not colon or not name:
        raise BadLine(f"bad line {line!r}")
    kind, *extra = rest.split("|")
    rate, labels = 1.0, []
    for x in extra:
        if x.startswith("@"):
            rate = number(x[1:])
            if not 0 < rate <= 1:
                raise BadLine(f"bad sample rate in {line!r}")
        elif x.startswith("#"):
            for tag in x[1:].split(","):
                if tag:
                    k, c, v = tag.partition(":")
                    labels.append((identifier(k), v if c else "true"))
        else:
            raise BadLine(f"unknown part {x!r}")
    metric = identifier(name, metric=True)
    if kind == "c":
        return [(metric, sorted(labels), "c", number(raw) / rate, False)]
    if kind == "g":
        return [(metric, sorted(labels), "g", number(raw), raw[:1] in "+-")]
    if kind in ("ms", "h", "d"):
        return [(metric, sorted([*labels, ("statsd_sample_rate", f"{rate:g}")] if rate != 1 else labels), kind, number(raw), False)]
    if kind == "s":
        return [(metric, sorted([*labels, ("statsd_set_member", raw)]), "s", 1.0, False)]
    raise BadLine(f"unknown type {kind!r}")


def statsd(lines: DataFrame, *, line_col: str = "value", ts_col: str = "ts", state: DataFrame | None = None) -> DataFrame:
    """Rows (metric, labels, ts, value, kind, seq) of received lines (``seq`` their order).

    A relative gauge adds to the gauge's value so far: the last absolute value
    (or ``state``: metric, labels, value) plus the relative ones since, as a
    running sum restarted at each absolute value.
    """
    ship(lines.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(*r, ts, seq) for line, ts, seq in zip(df["line"], df["ts"], df["seq"], strict=True) for r in statsd_line(line)]
            yield pd.DataFrame(rows, columns=["metric", "labels", "kind", "value", "relative", "ts", "seq"])

    numbered = lines if "seq" in lines.columns else lines.withColumn("seq", F.monotonically_increasing_id())
    raw = numbered.select(F.col(line_col).alias("line"), F.col(ts_col).cast("long").alias("ts"), "seq").mapInPandas(run, f"metric string, labels {LABELS}, kind string, value double, relative boolean, ts long, seq long")
    gauges = raw.where("kind = 'g'")
    if state is not None:
        first = state.select("metric", "labels", F.lit("g").alias("kind"), "value", F.lit(False).alias("relative"), F.lit(-(1 << 62)).alias("ts"), F.lit(-1).cast("long").alias("seq"))
        gauges = gauges.unionByName(first)
    w = Window.partitionBy("metric", "labels").orderBy("ts", "seq")
    era = F.sum(F.when(F.col("relative"), 0).otherwise(1)).over(w)
    within = Window.partitionBy("metric", "labels", "_era").orderBy("ts", "seq")
    gauges = gauges.withColumn("_era", era).withColumn("value", F.sum("value").over(within)).drop("_era").where("seq >= 0")
    return whole(raw.where("kind != 'g'").unionByName(gauges)).select("metric", "labels", "ts", "value", "kind", "seq")


# NDJSON export

def ndjson(line: str, default_ts: int) -> list[Row]:
    """``{"metric": {"__name__": ..., ...}, "values": [...], "timestamps": [...]}``."""
    if not line.strip():
        return []
    d = json.loads(line)
    labels = dict(d["metric"])
    name = labels.pop("__name__")
    if len(d["values"]) != len(d["timestamps"]):
        raise BadLine("values and timestamps differ in length")
    return [(name, sorted(labels.items()), int(t), float(v) if v is not None else math.nan) for t, v in zip(d["timestamps"], d["values"], strict=True)]


PARSERS: dict[str, Callable[..., list[Row]]] = {"exposition": exposition, "measurement": measurement, "graphite": graphite, "ndjson": ndjson}


def read(lines: DataFrame, form: str, *, line_col: str = "value", default_ts: int = 0, ts_col: str | None = None, strict: bool = True, **options) -> DataFrame:
    """(metric, labels, ts, value) of a frame of lines.

    A line without a time has that of its ``ts_col``, else ``default_ts``. A
    bad line fails the read, or is left out with ``strict`` False; null lines
    have no rows.
    """
    ship(lines.sparkSession)
    parse = PARSERS[form]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows: list[Row] = []
            for line, at in zip(df["line"], df["at"], strict=True):
                try:
                    rows += parse(line, int(at), **options) if line is not None else []
                except (BadLine, ValueError, KeyError):
                    if strict:
                        raise
            yield pd.DataFrame(rows, columns=["metric", "labels", "ts", "value"])

    at = F.lit(default_ts) if ts_col is None else F.coalesce(F.col(ts_col), F.lit(default_ts))
    return whole(lines.select(F.col(line_col).cast("string").alias("line"), at.cast("long").alias("at")).mapInPandas(run, SCHEMA))


def read_exemplars(lines: DataFrame, *, line_col: str = "value", default_ts: int = 0) -> DataFrame:
    """(metric, labels, exemplar_labels, ts, value) of exposition lines with an exemplar."""
    ship(lines.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for line in df["line"]:
                found = exposition_line(line, default_ts) if line is not None else None
                if found and found[1]:
                    (metric, labels, ts, _), (own, value, at) = found
                    rows.append((metric, labels, own, at if at is not None else ts, value))
            yield pd.DataFrame(rows, columns=["metric", "labels", "exemplar_labels", "ts", "value"])

    return whole(lines.select(F.col(line_col).alias("line")).mapInPandas(run, f"metric string, labels {LABELS}, exemplar_labels {LABELS}, ts long, value double"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Verification of a migration: rows (metric, labels, ts, left, right) that differ or are missing on a side."""
    keys = ["metric", "labels", "ts"]
    a = left.groupBy(*keys).agg(F.min("value").alias("left"), F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(*keys).agg(F.min("value").alias("right"), F.count(F.lit(1)).alias("n_right"))
    return a.join(b, keys, "full_outer").where(~F.col("left").eqNullSafe(F.col("right")) | ~F.col("n_left").eqNullSafe(F.col("n_right")))
