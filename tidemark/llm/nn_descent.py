"""Approximate nearest neighbours: NN-descent graph and greedy graph search.

The graph of ``k`` neighbours a vector starts from seeded random neighbours.
A round sends each vector to its neighbours in both directions (a shuffle by
vertex), so that the neighbours of one vertex meet: pairs of them are
neighbours of neighbours. Each such meeting compares its vectors in one
matrix product and sends every member those met that beat its worst
neighbour; a second shuffle merges them into the lists. Only pairs with a
neighbour that is new since the last round are compared. Rounds end when few
lists change.

Rounds work on vectors scaled to unit length and rounded to bytes. Where more
than ``fan`` vectors meet at one vertex, they are dealt to groups of about that
size, other groups each round, so that a hub's neighbours all take part and no
task holds more than a group. The search expands a query's best until all of
its beam are expanded. It is exact at its end: the score of a candidate is the
cosine of the original vectors in double precision.

Equal vectors are one class, so a vector that a third of the rows hold is one
vertex; a class keeps its smallest ids, which is all a ranking can use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import discard, settle
from .minhash import grouped


def usable(vector: str):
    """Not null, not zero, without null or non-finite components."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _packed(g: dict[str, np.ndarray], column: str, kind=np.int8) -> np.ndarray:
    return np.frombuffer(b"".join(g[column]), kind).reshape(len(g[column]), -1)


def _quantize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        if len(df):
            v = np.stack([np.asarray(x, np.float64) for x in df["vec"]])
            with np.errstate(all="ignore"):
                v /= np.abs(v).max(axis=1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                top = np.abs(v).max(axis=1, keepdims=True)
                q = np.rint(v / top * 127).astype(np.int8)
            yield pd.DataFrame({"node": df["node"], "q": [x.tobytes() for x in q]})


def _unit(q: np.ndarray) -> np.ndarray:
    v = q.astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _meetings(best: int):
    """In each group at a vertex: pairs of its neighbours, at least one of them new, that beat the receiver's worst."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to: list[np.ndarray] = []
        met: list[np.ndarray] = []
        sims: list[np.ndarray] = []
        held = 0
        for g in grouped(frames, ("at", "salt")):
            # a neighbour in both directions comes twice; once new is new
            order = np.lexsort((-g["fresh"], g["node"]))
            _, first = np.unique(g["node"][order], return_index=True)
            g = {c: x[order[first]] for c, x in g.items()}
            ids = g["node"]
            if len(ids) < 2 or not g["fresh"].any():
                continue
            v = _unit(_packed(g, "q"))
            s = v @ v.T
            fresh = g["fresh"] > 0
            s[~(fresh[:, None] | fresh[None, :])] = -2
            np.fill_diagonal(s, -2)
            n = min(best, len(ids) - 1)
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            values = np.take_along_axis(s, top, axis=1)
            row, col = np.nonzero(values > g["worst"][:, None])
            to.append(ids[row])
            met.append(ids[top[row, col]])
            sims.append(values[row, col])
            held += len(row)
            if held > 200_000:
                yield pd.DataFrame({"node": np.concatenate(to), "other": np.concatenate(met), "sim": np.concatenate(sims)})
                to, met, sims, held = [], [], [], 0
        if to:
            yield pd.DataFrame({"node": np.concatenate(to), "other": np.concatenate(met), "sim": np.concatenate(sims)})

    return run


def _lists(k: int):
    """At each vertex: the ``k`` best of old and met neighbours; ``fresh`` marks those just met."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, others, sims, fresh, changed = [], [], [], [], []
        for g in grouped(frames, ("node", "salt")):
            order = np.lexsort((g["other"], g["fresh"], -g["sim"]))
            other, sim = g["other"][order], g["sim"][order]
            old = set(g["other"][g["fresh"] == 0].tolist())
            _, first = np.unique(other, return_index=True)
            first = np.sort(first)[:k]
            chosen = other[first]
            mark = np.array([0 if o in old else 1 for o in chosen.tolist()], np.int8)
            node.append(int(g["node"][0]))
            others.append(chosen)
            sims.append(sim[first].astype(np.float32))
            fresh.append(mark)
            changed.append(int(mark.sum()))
            if len(node) >= 5000:
                yield pd.DataFrame({"node": node, "others": others, "sims": sims, "fresh": fresh, "changed": changed})
                node, others, sims, fresh, changed = [], [], [], [], []
        if node:
            yield pd.DataFrame({"node": node, "others": others, "sims": sims, "fresh": fresh, "changed": changed})

    return run


GRAPH = "node long, others array<long>, sims array<float>, fresh array<tinyint>, changed int"


def _grouped_by(df: DataFrame, key: str) -> DataFrame:
    """Rows of a key (and ``salt``, 0 without one) together in one partition.

    Dealt by a hash of the key: a shuffle by the key itself is left out where
    a join before it has the same keys, and adaptive execution may then split
    one key's rows over tasks.
    """
    df = df if "salt" in df.columns else df.withColumn("salt", F.lit(0))
    return df.repartition(F.xxhash64(key, "salt")).sortWithinPartitions(key, "salt")


def build_graph(nodes: DataFrame, count: int, *, k: int, best: int, fan: int, rounds: int, stop: float, seed: int, broadcast_rows: int = 500_000) -> DataFrame:
    """(node, others, sims): the neighbour lists of ``nodes`` (node 0..count-1, q)."""
    picks = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.pmod(F.xxhash64("node", i, F.lit(seed)), F.lit(max(count, 1))))
    others = F.filter(F.array_distinct(picks), lambda x: x != F.col("node"))
    same = lambda value, kind: F.transform("others", lambda _: F.lit(value).cast(kind))
    graph = nodes.select("node", others.alias("others")).select("node", "others", same(-1.0, "float").alias("sims"), same(1, "tinyint").alias("fresh"), F.size("others").alias("changed"))
    graph = settle(graph, "graph")
    for turn in range(rounds):
        flat = graph.select("node", F.explode(F.arrays_zip("others", "fresh")).alias("e")).select("node", F.col("e.others").alias("other"), F.col("e.fresh").alias("fresh"))
        worst = graph.select("node", F.when(F.size("sims") < k, F.lit(-1.5)).otherwise(F.array_min("sims")).cast("float").alias("worst"))
        both = flat.select(F.col("other").alias("at"), "node", "fresh").union(flat.select(F.col("node").alias("at"), F.col("other").alias("node"), "fresh"))
        # a vertex is a hub by how many lists name it; its own list adds at most k
        hubs = settle(flat.groupBy(F.col("other").alias("at")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") + k > fan), "hubs")
        near = F.broadcast(hubs) if hubs.count() <= broadcast_rows else hubs
        groups = F.ceil((F.coalesce("c", F.lit(0)) + k) / fan)
        both = both.join(near, "at", "left").withColumn("salt", F.pmod(F.xxhash64("node", "at", F.lit(turn)), groups).cast("long"))
        sent = both.join(nodes.join(worst, "node", "left").select("node", "q", F.coalesce("worst", F.lit(-1.5).cast("float")).alias("worst")), "node")
        found = _grouped_by(sent.select("at", "salt", "node", "q", "fresh", "worst"), "at").mapInPandas(_meetings(best if turn else min(best, 4)), "node long, other long, sim float")
        old = graph.select("node", F.explode(F.arrays_zip("others", "sims")).alias("e")).select("node", F.col("e.others").alias("other"), F.col("e.sims").alias("sim"), F.lit(0).cast("tinyint").alias("fresh"))
        found = found.withColumn("fresh", F.lit(1).cast("tinyint"))
        after = settle(_grouped_by(old.union(found), "node").mapInPandas(_lists(k), GRAPH), "graph")
        discard(graph, hubs)
        graph = after
        if graph.agg(F.coalesce(F.sum("changed"), F.lit(0))).first()[0] <= stop * k * count:
            break
    return graph


def search(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 50,
    top: int = 5,
    k: int = 40,
    best: int = 10,
    fan: int = 100,
    rounds: int = 12,
    stop: float = 0.02,
    beam: int = 128,
    seed: int = 11,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each row whose id is divisible by ``every``.

    Candidates are all rows but the query's own; nearness is the cosine, ties
    to the smaller id. Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do rows with a null id or vectors of another
    length than most have (of lengths as common, the longer). With at most
    ``top`` candidates all are returned, an empty table gives none, and other
    columns are not read. Rows that repeat an id are one candidate; if their
    vectors differ, one of them stands for the id, the same in every run.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull())
    common = rows.groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size(vector_col) == common.n)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("vec"))
    # squares of extreme components would leave the range of a double; a cosine is the same at any scale
    top_size = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    rows = rows.withColumn("vec", F.when(top_size.between(1e-100, 1e100), F.col("vec")).otherwise(F.transform("vec", lambda x: x / top_size)))
    # A class keeps as many of its smallest ids as a ranking of ``top`` can use, its queries' own aside.
    hashed = lambda df: df.withColumn("h", F.xxhash64("vec")).withColumn("g", F.md5(F.concat_ws(",", "vec").cast("binary")))
    owned = hashed(rows).groupBy("id").agg(F.min(F.struct("h", "g")).alias("o")).select("id", "o.h", "o.g")
    owned = settle(owned, "vector-owners")
    firsts = owned.groupBy("h", "g").agg(F.min("id").alias("first"))
    dense = settle(firsts.select("first", "h", "g").withColumn("part", F.spark_partition_id()), "vector-classes")
    sizes = {r.part: r["count"] for r in dense.groupBy("part").count().collect()}
    offsets, count = [], 0
    for p in sorted(sizes):
        offsets.append((p, count))
        count += sizes[p]
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, base long"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    dense = dense.withColumn("number", number).join(starts, "part").select("h", "g", "first", (F.col("base") + F.col("number")).alias("node"))
    dense = settle(dense, "vector-nodes")
    member = settle(owned.join(dense.drop("first"), ["h", "g"]).select("id", "node"), "members")
    nodes = hashed(rows).join(dense.withColumnRenamed("first", "id"), ["id", "h", "g"]).select("node", "id", "vec").dropDuplicates(["node"])
    nodes = settle(nodes.withColumnRenamed("id", "first"), "vectors")
    packed = settle(nodes.select("node", "vec").mapInPandas(_quantize, "node long, q binary"), "packed")
    graph = build_graph(packed, count, k=k, best=best, fan=fan, rounds=rounds, stop=stop, seed=seed, broadcast_rows=broadcast_rows)
    queries = member.where(F.col("id") % every == 0)
    asked = queries.select("node").distinct()
    found = _walk(asked, packed, graph, count, beam=beam, seed=seed, broadcast_rows=broadcast_rows)
    exact = found.select(F.col("query").alias("a"), F.col("node").alias("b")).union(asked.select("node", "node")).distinct()
    exact = exact.join(nodes.select(F.col("node").alias("a"), F.col("vec").alias("va")), "a").join(nodes.select(F.col("node").alias("b"), "first", F.col("vec").alias("vb")), "b")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    exact = exact.select("a", "b", "first", (dot("va", "vb") / F.sqrt(dot("va", "va")) / F.sqrt(dot("vb", "vb"))).alias("score"))
    near = Window.partitionBy("a").orderBy(F.desc("score"), "first")
    exact = exact.withColumn("r", F.row_number().over(near)).where(F.col("r") <= beam).select("a", "b", "score")
    return _ranked(exact, queries, member, top)


def _ranked(exact: DataFrame, queries: DataFrame, member: DataFrame, top: int) -> DataFrame:
    """Ids for classes, and the ranking of each query."""
    low = member.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= top + 1)
    ids = low.groupBy("node").agg(F.collect_list("id").alias("ids"))
    out = queries.select(F.col("id").alias("query_id"), F.col("node").alias("a")).join(exact, "a").join(ids.withColumnRenamed("node", "b"), "b")
    out = out.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _beams(beam: int):
    """At each query: its ``beam`` best so far and its own vertex; ``fresh`` marks those not expanded yet."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in grouped(frames, ("query", "salt")):
            # products of bytes are whole numbers, so that a pair has the same nearness in every group
            v = _packed(g, "q").astype(np.float64)
            own = int(np.flatnonzero(g["node"] == g["query"])[0])
            near = (v @ v[own]) / np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-9)
            order = np.lexsort((g["fresh"], g["node"], -near))
            _, first = np.unique(g["node"][order], return_index=True)
            keep = order[np.sort(first)[:beam]]
            if not (g["node"][keep] == g["query"][0]).any():
                keep = np.append(keep, order[g["node"][order] == g["query"][0]][0])
            yield pd.DataFrame({"query": g["query"][keep], "node": g["node"][keep], "fresh": g["fresh"][keep]})

    return run


def _walk(asked: DataFrame, packed: DataFrame, graph: DataFrame, count: int, *, beam: int, seed: int, broadcast_rows: int) -> DataFrame:
    """(query, node): greedy search from the query's own vertex and seeded entries, ``beam`` wide.

    Ends when every vertex of every beam is expanded. A beam's worst only gets
    better, so a vertex that fell out never comes back, and it does end.
    """
    entries = F.concat(F.array("node"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.pmod(F.xxhash64("node", i, F.lit(-seed)), F.lit(count))))
    front = asked.select(F.col("node").alias("query"), F.explode(F.array_distinct(entries)).alias("node")).withColumn("fresh", F.lit(1))
    links = graph.select(F.col("node").alias("from"), F.explode("others").alias("node"))
    links = settle(links.union(links.select(F.col("node").alias("from"), F.col("from").alias("node"))).distinct(), "links")
    front = settle(front, "front")
    while left := front.where("fresh = 1").count():
        todo = front.where("fresh = 1").select("query", F.col("node").alias("from"))
        todo = F.broadcast(todo) if left <= broadcast_rows else todo
        out = todo.join(links, "from").select("query", "node", F.lit(1).alias("fresh"))
        every = out.union(front.select("query", "node", F.lit(0).alias("fresh")))
        after = _grouped_by(every.join(packed, "node").select("query", "node", "fresh", "q"), "query")
        after = settle(after.mapInPandas(_beams(beam), "query long, node long, fresh int"), "front")
        discard(front)
        front = after
    discard(links)
    return front
