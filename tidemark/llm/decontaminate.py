"""Benchmark decontamination by Wu-Manber search over words.

Every run of ``window`` benchmark words (a shorter item is one window) is a
pattern. Patterns of one length share a matcher: a table of shifts by word
pair says how far the search may jump, the bucket of the last pair holds the
windows to test, ordered by their first pair, so that a bucket of thousands is
halved down to the few that begin alike, and a direct comparison confirms each
occurrence. On text that shares no pair with the benchmark the search looks at
one word in twelve.

The benchmark travels as text, in blocks of bounded bytes; each worker makes
the tables of a block once, in arrays of word numbers. One block is the usual
case and needs one pass without a shuffle; a larger benchmark takes one written
pass a block, so neither the driver nor a task ever holds more than one block.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import discard, settle

#: Bytes to word text: A-Z lowered, everything but 0-9, a-z and non-ASCII a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text; null has none."""
    return text.translate(WORD_BYTES).split() if text else []


class WuManber:
    """Search for many word windows of one length ``m``.

    ``items`` are (owner, word numbers) of at least ``m`` words. Equal windows
    are one, with the owners of all.
    """

    def __init__(self, m: int, items: list[tuple[int, np.ndarray]]):
        self.m, self.block = m, min(2, m)
        flat = np.concatenate([w for _, w in items])
        sizes = np.array([len(w) for _, w in items])
        inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) <= np.repeat(sizes, sizes) - m
        starts = np.flatnonzero(inside)
        owner = np.repeat([o for o, _ in items], sizes)[starts]
        rows = np.ascontiguousarray(flat[starts[:, None] + np.arange(m)])
        suffix, prefix = self._pairs(rows, m - self.block), self._pairs(rows, 0)
        order = np.lexsort((*rows.T[::-1], prefix, suffix))
        rows, owner, suffix, prefix = rows[order], owner[order], suffix[order], prefix[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        own = np.unique(np.stack([group, owner], axis=1), axis=0)
        self.owner = own[:, 1].tolist()
        self.owner_at = np.searchsorted(own[:, 0], np.arange(len(first) + 1)).tolist()
        self.rows, self.prefix, suffix = rows[first], prefix[first].tolist(), suffix[first]
        begin = np.flatnonzero(np.concatenate([[True], suffix[1:] != suffix[:-1]]))
        #: Last pair to where its windows begin and end.
        self.buckets = dict(zip(suffix[begin].tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(suffix)], strict=True), strict=True))
        jumps: dict[int, int] = {}
        for end in range(self.block, m + 1):
            for pair in np.unique(self._pairs(self.rows, end - self.block)).tolist():
                jumps[pair] = m - end
        self.shift = jumps

    def _pairs(self, rows: np.ndarray, at: int) -> np.ndarray:
        return rows[:, at] if self.block == 1 else rows[:, at].astype(np.int64) << 32 | rows[:, at + 1]

    def search(self, words: list[int]) -> Iterator[tuple[int, list[int]]]:
        """(start, owners) of every occurrence in word numbers; words of no item are -1."""
        m, n, single = self.m, len(words), self.block == 1
        far, shift = m - self.block + 1, self.shift.get
        end = m
        while end <= n:
            last = words[end - 1]
            if last < 0:
                # no window holds this word
                end += m
                continue
            pair = last if single else words[end - 2] << 32 | last if words[end - 2] >= 0 else -1
            jump = shift(pair, far)
            if jump:
                end += jump
                continue
            start = end - m
            lo, hi = self.buckets[pair]
            first = words[start] if single else words[start] << 32 | words[start + 1] if words[start] >= 0 and words[start + 1] >= 0 else -1
            k = bisect_left(self.prefix, first, lo, hi)
            while k < hi and self.prefix[k] == first:
                if self.rows[k].tolist() == words[start:end]:
                    yield start, self.owner[self.owner_at[k] : self.owner_at[k + 1]]
                    break
                k += 1
            end += 1


Built = tuple[list[str], dict[bytes, int], list[WuManber]]


def build(items: Iterable[tuple[str, bytes]], window: int) -> Built:
    """Item names, numbers of their words, and one matcher for each window length that occurs."""
    names: dict[str, int] = {}
    numbers: dict[bytes, int] = {}
    by_length: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
    for name, text in items:
        words = words_of(text)
        if words:
            ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
            by_length[min(window, len(words))].append((names.setdefault(name, len(names)), ids))
    return list(names), numbers, [WuManber(m, own) for m, own in by_length.items()]


_made: dict[tuple[str, int], Built] = {}


def made(shared, window: int) -> Built:
    """The tables of a broadcast (name, block), made once a worker; only the newest block's are kept."""
    name, block = shared.value
    if (name, window) not in _made:
        _made.clear()
        _made[name, window] = build(block, window)
    return _made[name, window]


def hits(words: list[bytes], names: list[str], numbers: dict[bytes, int], matchers: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged (start, end) spans of hit words, and the items found."""
    spans: list[tuple[int, int]] = []
    found: set[str] = set()
    ids = [numbers.get(w, -1) for w in words]
    for matcher in matchers:
        for start, owners in matcher.search(ids):
            spans.append((start, start + matcher.m))
            found.update(names[o] for o in owners)
    return merge(spans), found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(bench: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of about ``block_bytes``; an item stays whole."""
    held, size = [], 0
    rows = bench.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t")).where("t is not null")
    for row in rows.toLocalIterator():
        if held and size + len(row.t) > block_bytes:
            yield held
            held, size = [], 0
        held.append((row.i if row.i is not None else "null", bytes(row.t)))
        size += len(row.t)
    if held:
        yield held


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _scan(shared, text_col: str, window: int):
    """Batches in, the same batches with the hits of one block merged into ``_found``."""
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("starts", pa.list_(pa.int32())),
            ("ends", pa.list_(pa.int32())),
            ("items", pa.list_(pa.string())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers, matchers = made(shared, window)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).cast(pa.binary())
            seen = batch.schema.get_field_index("_found")
            before = batch.column(seen).to_pylist()
            out = []
            for i in range(batch.num_rows):
                words = words_of(texts[i].as_py())
                spans, found = hits(words, names, numbers, matchers)
                if before[i] is not None:
                    spans = merge(spans + list(zip(before[i]["starts"], before[i]["ends"], strict=True)))
                    found |= set(before[i]["items"])
                out.append(
                    {
                        "n_words": len(words),
                        "starts": [a for a, _ in spans],
                        "ends": [b for _, b in spans],
                        "items": sorted(found),
                    }
                )
            columns = [c for k, c in enumerate(batch.columns) if k != seen] + [pa.array(out, kind)]
            fields = [f for k, f in enumerate(batch.schema) if k != seen]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields] + ["_found"])

    return run


def find(
    docs: DataFrame,
    bench: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    block_bytes: int = 2 << 20,
) -> DataFrame:
    """``docs`` with a struct ``_found``: word count, merged hit spans in words, items.

    Rows with null or empty text have no words and no hits; repeated rows each
    get their result; an empty benchmark hits nothing. Columns of ``docs``
    whatever their names pass through (``_found`` itself is replaced). Texts are
    read whole, however long; an empty table stays empty.
    """
    spark = docs.sparkSession
    ship(spark)
    none = F.lit(None).cast(FOUND)
    out = docs.drop("_found").withColumn("_found", none)
    written = None
    blocks = 0
    for block in _blocks(bench, item_id, item_text, block_bytes):
        if blocks:
            before, written = written, settle(out, "decontaminate")
            discard(before)
            out = written
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast((uuid.uuid4().hex, block)), text_col, window), out.schema)
        blocks += 1
    if not blocks:
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(("none", [])), text_col, window), out.schema)
    return out


def verdict(found: str = "_found", share: int = 20) -> dict:
    """Columns drawn from a ``find`` struct; contaminated at one hit word in ``share`` or more."""
    f = F.col(found)
    n_hit = F.aggregate(F.zip_with(f["ends"], f["starts"], lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return {
        "n_words": f["n_words"],
        "n_hit": n_hit,
        "n_items": F.size(f["items"]).cast("long"),
        "items_sha256": F.sha2(F.array_join(F.sort_array(f["items"]), ",").cast("binary"), 256),
        "contaminated": (n_hit > 0) & (n_hit * share >= f["n_words"]),
    }


def drop_contaminated(docs: DataFrame, bench: DataFrame, *, share: int = 20, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    return find(docs, bench, **options).where(~verdict(share=share)["contaminated"]).select(*[f"`{c}`" for c in docs.columns])


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
