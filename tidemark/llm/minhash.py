"""Near-duplicate documents by MinHash with tensored banding, confirmed exactly.

A document's set holds its distinct five-word shingles. Two collections of
``halves`` sub-keys of ``half_rows`` minhashes each are computed; every pair
of a sub-key of the first and one of the second keys a table. So 64 tables of
six minhashes cost 48 minhashes instead of 384.

1. One pass over the texts makes, for each document, its set's size, a 128-bit
   digest of the set, table keys and a sketch. Equal sets become one class and
   stay one row from here on.
2. Classes that share a table key meet in blocks of about ``block`` rows
   and are compared by sketch; each block returns a forest of probable links,
   never all pairs. Buckets with the same members are compared once. A bucket
   of several blocks is dealt twice by different deals; then every class
   outside the bucket's largest part meets all of the bucket, so each pair not
   yet known to be connected is compared.
3. The components of those forests are *clusters*. Each member's full set is
   sent to its cluster once. A cluster of at most ``block`` classes is linked
   there exactly. A larger one is dealt to blocks, twice by different deals;
   then every class outside the cluster's largest part visits all blocks, so
   each pair not yet known to be connected is compared.

No step emits the pairs of a group, and a task holds the sets of one block, or
of a block and its visitors, at a time: ``block`` classes, fewer of long texts.
Texts at the similarity itself share a table with probability 0.999 at 0.85 and
0.994 at 0.80.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import discard, settle
from .components import components

U = np.uint64
#: Words a worker remembers.
MEMO = 50_000
#: Entries of an inverted index counted at once, and bytes of the sets of a block.
HITS, BLOCK_BYTES = 1 << 20, 32 << 20


def splitmix(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit values (wrapping arithmetic)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(dict):
    """Word bytes to 64-bit hashes, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


def shingle_set(text: bytes | None, words: Words, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence of a shorter text is one; empty without words."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, U)
    ids = np.array([words[w] for w in found], U)
    n = max(1, len(ids) - size + 1)
    with np.errstate(over="ignore"):
        h = np.full(n, U(min(len(ids), size)))
        for k in range(min(size, len(ids))):
            h = splitmix(h ^ ids[k : k + n])
    return np.unique(h)


class Signer:
    """Table keys and sketch of a shingle set."""

    def __init__(self, halves: int, half_rows: int, bins: int = 256):
        self.halves, self.half_rows = halves, half_rows
        n = 2 * halves * half_rows
        with np.errstate(over="ignore"):
            seeds = splitmix(np.arange(2 * n, dtype=U) * U(7) + U(1))
            self.add, self.mul = seeds[:n], seeds[n:] | U(1)
            self.table = splitmix(np.arange(halves * halves, dtype=U) + U(99)).reshape(halves, halves)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.add), U(0xFFFFFFFFFFFFFFFF))
        with np.errstate(over="ignore"):
            for at in range(0, len(shingles), 4096):
                part = (shingles[at : at + 4096, None] ^ self.add) * self.mul
                np.minimum(low, part.min(axis=0), out=low)
            sub = np.zeros(2 * self.halves, U)
            for r in range(self.half_rows):
                sub = splitmix(sub ^ low[r :: self.half_rows])
            return splitmix(splitmix(sub[: self.halves, None] + self.table) ^ sub[None, self.halves :]).ravel()

    @staticmethod
    def sketch(shingles: np.ndarray) -> np.ndarray:
        """One-permutation minhash: 256 bins by the top byte, a byte 1-255 of each bin's least hash, 0 where empty."""
        out = np.zeros(256, np.uint8)
        bins, first = np.unique(shingles >> U(56), return_index=True)
        out[bins.astype(np.int64)] = (shingles[first] >> U(20)).astype(np.int64) % 255 + 1
        return out


def _sign(size: int, halves: int, half_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signer = Words(), Signer(halves, half_rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).cast(pa.binary())
                n, hi, lo, keys, sketches = [], [], [], [], []
                for t in texts:
                    s = shingle_set(t.as_py(), words, size)
                    n.append(len(s))
                    if len(s):
                        raw = xxhash.xxh3_128_digest(s.tobytes())
                        hi.append(int.from_bytes(raw[:8], "big", signed=True))
                        lo.append(int.from_bytes(raw[8:], "big", signed=True))
                        keys.append(signer.keys(s).view(np.int64))
                        sketches.append(signer.sketch(s).tobytes())
                    else:
                        for c in (hi, lo, keys, sketches):
                            c.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    names=["doc", "n", "hi", "lo", "keys", "sketch"],
                )

    return run


class Forest:
    """Union-find over 0..n-1 that keeps the joining edges."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def grouped(frames: Iterator[pd.DataFrame], by: tuple[str, str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups of rows sorted by two integer columns, across batch borders, as arrays by column."""
    rest: dict[str, np.ndarray] | None = None
    for df in frames:
        if df.empty:
            continue
        cols = {c: df[c].to_numpy() for c in df.columns}
        if rest is not None:
            cols = {c: np.concatenate([rest[c], v]) for c, v in cols.items()}
        x, y = cols[by[0]], cols[by[1]]
        starts = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        at = 0
        for end in starts:
            yield {c: v[at:end] for c, v in cols.items()}
            at = end
        rest = {c: v[at:] for c, v in cols.items()}
    if rest is not None:
        yield rest


def _alike(one: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Indices of the sketches in ``others`` whose similarity to ``one`` is ``least`` or more."""
    same = ((others == one) & (one > 0)).sum(axis=1)
    some = ((others > 0) | (one > 0)).sum(axis=1)
    return np.flatnonzero(same >= least * some)


def _probable(least: float):
    """Blocks of classes in one table: forest edges of sketch similarity ``least`` or more.

    In blocks with visitors only visitors meet the block's own classes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a: list[int] = []
        b: list[int] = []
        for g in grouped(frames, ("key", "salt")):
            ids = g["rep"]
            if len(ids) < 2:
                continue
            s = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(ids), 256)
            forest = Forest(len(ids))
            if "visitor" in g:
                visiting = g["visitor"].astype(bool)
                own = np.flatnonzero(~visiting)
                theirs = s[own]
                for i in np.flatnonzero(visiting):
                    for j in own[_alike(s[i], theirs, least)]:
                        if ids[i] != ids[j]:
                            forest.union(int(i), int(j))
            else:
                for i in range(len(ids) - 1):
                    for j in _alike(s[i], s[i + 1 :], least):
                        forest.union(i, i + 1 + int(j))
            a += [int(ids[x]) for x, _ in forest.edges]
            b += [int(ids[y]) for _, y in forest.edges]
            if len(a) > 50_000:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = [], []
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each index in ``left``, the indices in ``right`` whose sets reach the similarity, exactly.

    100 * intersection >= percent * union, with intersections counted through
    an inverted index of the right side, about ``HITS`` entries at a time.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(right)), sizes[right])
    values = np.concatenate([sets[r] for r in right]) if len(right) else np.empty(0, U)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for i in left:
        lo, hi = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        n = hi - lo
        both, upto, first = np.zeros(len(right), np.int64), np.cumsum(n), 0
        while first < len(n):
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + HITS, "right")))
            part, size = n[first:last], int(upto[last - 1] - done)
            at = np.repeat(lo[first:last] - np.cumsum(part) + part, part) + np.arange(size)
            both += np.bincount(owner[at], minlength=len(right))
            first = last
        yield int(i), right[(100 * both >= percent * (sizes[i] + sizes[right] - both)) & (both > 0)]


def _sets_of(g: dict[str, np.ndarray]) -> list[np.ndarray]:
    return [np.frombuffer(x, U) for x in g["set"]]


def _exact(percent: int):
    """Blocks of one cluster: forest edges of the exact links within the block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in grouped(frames, ("cluster", "salt")):
            ids, sets = g["rep"], _sets_of(g)
            forest = Forest(len(ids))
            index = np.arange(len(ids))
            for i, near in similar(sets, index, index, percent):
                for j in near:
                    forest.union(i, int(j))
            e = np.array(forest.edges, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": ids[e[:, 0]], "b": ids[e[:, 1]]})

    return run


def _visits(percent: int):
    """Blocks with visitors: forest edges of the links between visitors and the block's own classes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in grouped(frames, ("cluster", "salt")):
            ids, sets, visiting = g["rep"], _sets_of(g), g["visitor"].astype(bool)
            forest = Forest(len(ids))
            own = np.flatnonzero(~visiting)
            for i, near in similar(sets, np.flatnonzero(visiting), own, percent):
                for j in near:
                    if ids[i] != ids[j]:
                        forest.union(i, int(j))
            e = np.array(forest.edges, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": ids[e[:, 0]], "b": ids[e[:, 1]]})

    return run


def _texts_to_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            sets = pa.array([shingle_set(t.as_py(), words, size).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], names=["rep", "cluster", "set"])

    return run


def _salted(df: DataFrame, key: str, size: str, block: int, seed: int) -> DataFrame:
    """Deals large groups to blocks: ``salt`` is 0 in groups of at most ``block`` rows."""
    blocks = F.ceil(F.col(size) / block)
    return df.withColumn("salt", F.when(blocks > 1, F.pmod(F.xxhash64("rep", key, F.lit(seed)), blocks)).otherwise(F.lit(0)).cast("long"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 85,
    halves: int = 8,
    half_rows: int = 3,
    margin: float = 0.1,
    block: int = 2048,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked at 100 * intersection >= percent * union of their
    sets; a component is named by its smallest id and keeps that document. Null
    texts and texts without words have an empty set, link with nothing and are
    kept; so are rows with a null id, which are never linked. Repeated rows each
    get the same result. Ids name documents: if one id has several texts, one
    of them stands for it. An empty table gives none, texts are read whole, and
    other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    schema = "doc long, n long, hi long, lo long, keys array<long>, sketch binary"
    signed = settle(rows.mapInArrow(_sign(size, halves, half_rows), schema), "signed")
    some = signed.where("n > 0 and doc is not null")
    reps = settle(some.groupBy("hi", "lo").agg(F.min("doc").alias("rep")), "classes")
    own = reps.select("hi", "lo", F.col("rep").alias("doc"))
    classes = some.join(own, ["hi", "lo", "doc"]).select(F.col("doc").alias("rep"), "hi", "lo", "keys", "sketch")
    keyed = settle(classes.select("rep", F.explode("keys").alias("key")).distinct(), "keys")
    member = F.xxhash64("rep")
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(member).alias("x"), F.min("rep").alias("least")).where("m > 1")
    buckets = settle(buckets.groupBy("m", "x", "least").agg(F.min("key").alias("key")), "buckets")
    met = keyed.join(buckets.select("key", "m"), "key")
    sketches = classes.select("rep", "sketch").dropDuplicates(["rep"])
    least = percent / 100 - margin
    probable = _sketched(_salted(met, "key", "m", block, 0), sketches, least)
    large = buckets.where(F.col("m") > block).select("key", "m")
    if large.limit(1).count():
        large = settle(keyed.join(F.broadcast(large), "key"), "large-buckets")
        probable = settle(probable.union(_sketched(_salted(large, "key", "m", block, 4), sketches, least)), "probable")
        met = _visited(large, components(probable), block)
        probable = probable.union(_sketched(met, sketches, least))
    clusters = components(probable).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    clusters = settle(clusters, "clusters")
    near = F.broadcast(clusters) if clusters.count() <= broadcast_rows else clusters
    texts = rows.join(near, rows["doc"] == near["rep"]).select("rep", "cluster", "text")
    sets = texts.mapInArrow(_texts_to_sets(size), "rep long, cluster long, set binary").dropDuplicates(["rep"])
    sets = settle(sets, "sets")
    # a cluster of long texts counts as so many more classes that its blocks stay under BLOCK_BYTES
    sizes = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("set")).alias("bytes"))
    sizes = sizes.select("cluster", F.greatest("m", F.when(F.col("bytes") > BLOCK_BYTES, F.ceil(F.col("bytes") / BLOCK_BYTES) * block + 1)).alias("m"))
    whole, sets = sets, settle(sets.join(sizes, "cluster"), "cluster-sets")
    discard(whole)
    links = _linked(sets, percent, block, 1)
    large = sets.where(F.col("m") > block)
    if large.limit(1).count():
        links = settle(links.union(_linked(large, percent, block, 2)), "large-links")
        met = _visited(large.select(F.col("cluster").alias("key"), "rep", "m"), components(links), block)
        met = met.join(sets.select("rep", "set"), "rep").select(F.col("key").alias("cluster"), "salt", "rep", "set", "visitor")
        met = met.repartition(F.xxhash64("cluster", "salt")).sortWithinPartitions("cluster", "salt")
        links = links.union(met.mapInPandas(_visits(percent), "a long, b long"))
    final = components(links)
    named = reps.join(final, F.col("rep") == F.col("node"), "left").select("hi", "lo", F.coalesce("component", "rep").alias("component_id"))
    discard(keyed, sets)
    out = signed.select("doc", "n", "hi", "lo").join(named, ["hi", "lo"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def _sketched(met: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    blocks = met.join(sketches, "rep").select("key", "salt", "rep", "sketch", *[c for c in met.columns if c == "visitor"])
    return blocks.repartition(F.xxhash64("key", "salt")).sortWithinPartitions("key", "salt").mapInPandas(_probable(least), "a long, b long")


def _visited(large: DataFrame, part: DataFrame, block: int) -> DataFrame:
    """Blocks in which each class outside the largest part of its bucket (or cluster) meets every class of it.

    A bucket's classes are dealt to blocks and its visitors to shares of about
    ``block``; each block meets each share in a group of its own, so that a
    bucket of many small parts makes more groups, not larger ones.
    """
    part = part.select(F.col("node").alias("rep"), "component")
    placed = settle(large.join(part, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "large-bucket-parts")
    parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"))
    main = settle(main.select("key", F.col("top.component").alias("main"), (F.col("all") - F.col("top.c")).alias("v")).where("v > 0"), "large-bucket-mains")
    placed = placed.join(F.broadcast(main), "key").withColumn("blocks", F.ceil(F.col("m") / block)).withColumn("shares", F.ceil(F.col("v") / block))
    deal = lambda n, seed: F.pmod(F.xxhash64("rep", "key", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = placed.withColumn("at", deal("blocks", 5)).withColumn("share", every("shares")).withColumn("visitor", F.lit(False))
    visiting = placed.where("component != main").withColumn("share", deal("shares", 6)).withColumn("at", every("blocks")).withColumn("visitor", F.lit(True))
    columns = ["key", "rep", "visitor", (F.col("at") * F.col("shares") + F.col("share")).alias("salt")]
    return dealt.select(columns).union(visiting.select(columns))


def _linked(sets: DataFrame, percent: int, block: int, seed: int) -> DataFrame:
    dealt = _salted(sets, "cluster", "m", block, seed).select("cluster", "salt", "rep", "set")
    return dealt.repartition(F.xxhash64("cluster", "salt")).sortWithinPartitions("cluster", "salt").mapInPandas(_exact(percent), "a long, b long")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose document is its component's kept one."""
    judged = near_duplicates(docs, id_col=id_col, **options)
    gone = judged.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
