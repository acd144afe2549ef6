"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of ``SEGMENT`` bytes. A forward GRU reads each
segment and the ``CONTEXT`` bytes before it, a backward one the segment and
the bytes after it, so that every position sees at least so far beyond either
end of its segment; what is further away, a position does not see. Every byte
position gets label probabilities from the two states, and a document's
probabilities are the mean over all its positions. The network is trained in
numpy by backpropagation through time on segments of the whole texts of a
bounded number of labelled documents, and broadcast (some tens of kilobytes).

Arrays are laid out with features first and segments last, so each time step
is a few whole-array operations over thousands of segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import crc_mod

SEGMENT = 64
#: Bytes that each direction reads before the first position it judges.
CONTEXT = 32
#: Segments that go through the network together.
BATCH = 2048
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, np.float32(0.5), out=x)
    np.tanh(x, out=x)
    np.multiply(x, np.float32(0.5), out=x)
    return np.add(x, np.float32(0.5), out=x)


@dataclass
class Direction:
    """One GRU: ``w`` (3H, 256) holds input weights and biases of update, reset and candidate."""

    w: np.ndarray
    u: np.ndarray
    c: np.ndarray

    def states(self, x: np.ndarray, live: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """x (L, B) bytes in reading order; returns (L, H, B). Where ``live`` is 0 the state is zero."""
        length, batch = x.shape
        h3, hid = self.w.shape[0], self.u.shape[1]
        out = np.empty((length, hid, batch), np.float32)
        h = np.zeros((hid, batch), np.float32)
        a = np.empty((h3, batch), np.float32)
        g = np.empty((h3, batch), np.float32)
        for t in range(length):
            np.take(self.w, x[t], axis=1, out=a, mode="clip")
            np.matmul(self.u, h, out=g)
            q = g[2 * hid :]
            q += self.c
            zr = a[: 2 * hid]
            zr += g[: 2 * hid]
            _sigmoid(zr)
            z, r = zr[:hid], zr[hid:]
            n = out[t]
            np.multiply(r, q, out=n)
            n += a[2 * hid :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h.copy(), z.copy(), r.copy(), n.copy(), q.copy()))
            h = h - n
            h *= z
            h += n
            if live is not None:
                h *= live[t]
            out[t] = h
        return out

    def gradients(self, x: np.ndarray, live: np.ndarray, kept: list, dout: np.ndarray) -> dict[str, np.ndarray]:
        length, hid, batch = dout.shape
        du, dc = np.zeros_like(self.u), np.zeros_like(self.c)
        da = np.empty((length, 3 * hid, batch), np.float32)
        dh = np.zeros((hid, batch), np.float32)
        for t in range(length - 1, -1, -1):
            h, z, r, n, q = kept[t]
            dh = (dh + dout[t]) * live[t]
            an = dh * (1 - z) * (1 - n * n)
            az = dh * (h - n) * z * (1 - z)
            ar = an * q * r * (1 - r)
            da[t] = np.concatenate([az, ar, an])
            back = np.concatenate([az, ar, an * r])
            du += back @ h.T
            dc += back[2 * hid :].sum(axis=1, keepdims=True)
            dh = dh * z + self.u.T @ back
        flat = x.ravel()
        dw = np.stack([np.bincount(flat, da[:, k].ravel(), minlength=256) for k in range(3 * hid)])
        return {"w": dw.astype(np.float32), "u": du, "c": dc}


@dataclass
class Network:
    """Both directions and the readout to ``labels``."""

    labels: list[str]
    ahead: Direction
    back: Direction
    v: np.ndarray
    b: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        small = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        one = lambda: Direction(small(3 * hidden, 256), small(3 * hidden, hidden), np.zeros((hidden, 1), np.float32))
        return cls(labels, one(), one(), small(len(labels), 2 * hidden), np.zeros((len(labels), 1), np.float32))

    def positions(self, x: np.ndarray, live: np.ndarray | None, kept: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities (L, C, B) and states (L, 2H, B) for segments x (L, B)."""
        f = self.ahead.states(x, live, kept[0] if kept else None)
        r = self.back.states(x[::-1], None if live is None else live[::-1], kept[1] if kept else None)[::-1]
        s = np.concatenate([f, r], axis=1)
        return self.readout(s), s

    def readout(self, s: np.ndarray) -> np.ndarray:
        """Label probabilities of states (L, 2H, B)."""
        p = np.matmul(self.v, s)
        p += self.b
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def pooled(self, x: np.ndarray, before: np.ndarray, lengths: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Summed position probabilities (B, C) of segments x (B, CONTEXT + L + CONTEXT).

        So many bytes are live: ``before`` of the leading context, ``lengths``
        of the segment, ``after`` of the trailing context.
        """
        length = x.shape[1] - 2 * CONTEXT
        place = np.arange(x.shape[1])[:, None] - CONTEXT
        live = (((place >= -before) & (place < 0)) | ((place >= 0) & (place < lengths)) | ((place >= length) & (place < length + after))).astype(np.float32)
        xt, inner = np.ascontiguousarray(x.T), slice(CONTEXT, CONTEXT + length)
        f = self.ahead.states(xt[: CONTEXT + length], live[: CONTEXT + length])[CONTEXT:]
        r = self.back.states(xt[CONTEXT:][::-1], live[CONTEXT:][::-1])[CONTEXT:][::-1]
        p = self.readout(np.concatenate([f, r], axis=1))
        p *= live[inner, None]
        return p.sum(axis=0).T

    def parameters(self) -> dict[str, np.ndarray]:
        named = {f"{n}.{k}": getattr(d, k) for n, d in (("ahead", self.ahead), ("back", self.back)) for k in ("w", "u", "c")}
        return named | {"v": self.v, "b": self.b}

    def step(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over live positions; x (B, L), y (B,) label numbers."""
        xt = np.ascontiguousarray(x.T)
        live = (np.arange(x.shape[1])[:, None] < lengths).astype(np.float32)
        kept: tuple[list, list] = ([], [])
        p, s = self.positions(xt, live, kept)
        p[:, y, np.arange(len(y))] -= 1
        p *= live[:, None] / max(live.sum(), 1)
        ds = np.matmul(self.v.T, p)
        hid = ds.shape[1] // 2
        out = {"v": np.einsum("tcb,thb->ch", p, s, optimize=True), "b": p.sum(axis=(0, 2))[:, None]}
        out |= {f"ahead.{k}": g for k, g in self.ahead.gradients(xt, live, kept[0], ds[:, :hid]).items()}
        out |= {f"back.{k}": g for k, g in self.back.gradients(xt[::-1], live[::-1], kept[1], ds[::-1, hid:]).items()}
        return out


def segments(texts: list[bytes], length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x (B, L) zero-padded, live bytes (B,), text number (B,)) of whole texts."""
    counts = np.array([-(-len(t) // length) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    x = np.frombuffer(b"".join(t.ljust(int(c) * length, b"\0") for t, c in zip(texts, counts, strict=True)), np.uint8).reshape(-1, length)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    sizes = np.array([len(t) for t in texts], np.int64)
    return x, np.minimum(length, sizes[owner] - nth * length), owner


def windows(texts: list[bytes], length: int = SEGMENT, context: int = CONTEXT) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of whole texts with their contexts, ``BATCH`` at a time: (x, before, lengths, after, text number)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // length)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    pad = b"\0" * (context + length)
    flat = np.frombuffer(pad + b"".join(texts) + pad, np.uint8)
    start = np.repeat(np.cumsum(sizes) - sizes, counts) + nth * length
    left = sizes[owner] - nth * length
    for at in range(0, len(owner), BATCH):
        part = slice(at, at + BATCH)
        x = flat[start[part, None] + length + np.arange(context + length + context)]
        yield x, np.minimum(context, nth[part] * length), np.minimum(length, left[part]), np.clip(left[part] - length, 0, context), owner[part]


def train(texts: list[bytes], names: list[str], *, hidden: int = 6, steps: int = 150, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Network | None:
    """Adam on random segments, as many of each label; None without labelled texts."""
    labels = sorted(set(names))
    if not labels:
        return None
    x, lengths, owner = segments(texts)
    y = np.array([labels.index(n) for n in names])[owner]
    net, rng = Network.fresh(labels, hidden, seed), np.random.default_rng(seed)
    rows = [np.flatnonzero(y == k) for k in range(len(labels))]
    if any(len(r) == 0 for r in rows):
        raise ValueError("a label has no text")
    m = {k: np.zeros_like(v) for k, v in net.parameters().items()}
    s = {k: np.zeros_like(v) for k, v in net.parameters().items()}
    for t in range(1, steps + 1):
        take = np.concatenate([rng.choice(r, max(1, batch // len(rows))) for r in rows])
        for k, g in net.step(x[take], y[take], lengths[take]).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            net.parameters()[k] -= rate * (m[k] / (1 - 0.9**t) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, held_mod: int, held_rem: int, per_label: int = 240) -> tuple[list[bytes], list[str]]:
    """The whole texts of at most ``per_label`` rows of each label.

    They are the training rows with the smallest hash of their id. Every label
    is learned; the driver holds a row a label and the sampled texts.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, held_mod) != held_rem))
    counts = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy("lang").collect()
    if not counts:
        return [], []
    order = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(1 << 30))
    bound = F.lit(0)
    for r in counts:
        bound = F.when(F.col(lang_col) == r.lang, F.lit(int(min(1.0, 2.0 * per_label / r["count"]) * (1 << 30)))).otherwise(bound)
    near = rows.where((order < bound) & F.col(text_col).rlike(r"\p{L}"))
    near = near.select(F.col(lang_col).alias("lang"), order.alias("o"), F.col(text_col).alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("o", "text"))
    found = near.withColumn("nth", nth).where(F.col("nth") <= per_label).orderBy("lang", "nth").collect()
    return [x.text.encode() for x in found], [x.lang for x in found]


def predict(net: Network | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(label, its mean probability) of whole texts; ``und`` and 0 for null texts and those without a letter."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if net is None:
        return out
    known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    if not known:
        return out
    sums = np.zeros((len(known), len(net.labels)))
    for x, before, lengths, after, owner in windows([texts[i].encode() for i in known]):
        np.add.at(sums, owner, net.pooled(x, before, lengths, after))
    sums /= sums.sum(axis=1, keepdims=True)
    for i, p in zip(known, sums, strict=True):
        out[i] = (net.labels[int(p.argmax())], float(min(1.0, p.max())))
    return out


def _run(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                found = predict(net, batch.column(at).to_pylist())
                columns = [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "lang_score"])

    return run


def identify(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    held_mod: int = 4,
    held_rem: int = 2,
    learn_from: DataFrame | None = None,
    columns: list[str] | None = None,
    **training,
) -> DataFrame:
    """``docs`` (its ``columns``) with ``lang_pred`` and ``lang_score``.

    The network learns from rows of ``learn_from`` (by default ``docs``) with a
    label and an id whose crc32 modulo ``held_mod`` is not ``held_rem``; ids,
    labels and other columns are not inputs of a prediction. Without any
    labelled row everything is ``und`` with score 0, as are null texts and those
    without a letter. Texts are read whole, however long; repeated rows are
    judged alike, an empty table stays empty, and columns of the two names are
    replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    texts, names = sample(learn_from if learn_from is not None else docs, id_col=id_col, text_col=text_col, lang_col=lang_col, held_mod=held_mod, held_rem=held_rem)
    shared = spark.sparkContext.broadcast(train(texts, names, **training))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns or docs.columns]).drop("lang_pred", "lang_score")
    schema = rows.withColumns({"lang_pred": F.lit("").cast("string"), "lang_score": F.lit(0.0)}).schema
    return rows.mapInArrow(_run(shared, rows.columns.index(text_col)), schema)
