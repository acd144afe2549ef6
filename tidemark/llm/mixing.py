"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens flows down a tree of levels (by default domain, language,
source). Among siblings it is split by weight; a child that has less to give
than its share gives all, and what it leaves over goes to its siblings by
weight before the parent passes anything on. Since a node's capacity is what
its whole subtree may take, leaves under a weight of 0 aside, only a subtree
that is spent passes budget to its parent's siblings. This is water filling, solved in closed form by one window
a level over the tree, whose size is the number of leaves.

A leaf's documents repeat in epochs, each in its own seeded order; the leaf
takes whole epochs and then the prefix of the next one that fits. To find the
prefix of a leaf with a third of all rows, tokens are summed by hash bucket
first; only the bucket in which the prefix ends is ordered row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle


#: The tree of the registered query: sources by their number are the web, books or forums.
LEVELS = {
    "domain": "case when source in ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') then 'web' when source in ('src8', 'src9', 'src10', 'src11', 'src12') then 'books' else 'forums' end",
    "lang": "lang",
    "source": "source",
}
WEIGHTS = {"domain": {"web": 2, "books": 3, "forums": 1}, "lang": {"en": 4, "fr": 2, "de": 2, "es": 2}, "source": {"src0": 3}}


def tokens_of(text: Column) -> Column:
    """Four characters to a token, rounded up; null has none."""
    return F.coalesce(F.floor((F.length(text) + 3) / 4), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def allocate(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: Column) -> DataFrame:
    """``leaves`` (levels..., n, tokens, cap) with ``grant``, the tokens each may take.

    Weights are whole numbers, 1 where not given, and 0 takes nothing, nor
    does what is below it; grants are rounded down at each level. Capacity ties
    are broken by name.
    """
    taking = F.lit(True)
    for level in levels:
        taking = taking & (_weight(level, weights) > 0)
    out = leaves.withColumn("cap", F.when(taking, F.col("cap")).otherwise(0)).withColumn("grant", budget.cast("long"))
    for i, level in enumerate(levels):
        above, here = levels[:i], levels[: i + 1]
        nodes = out.groupBy(*here).agg(F.sum("cap").alias("c"), F.max("grant").alias("b")).withColumn("w", _weight(level, weights))
        nodes = nodes.withColumn("ratio", F.when(F.col("w") > 0, F.col("c") / F.col("w")).otherwise(F.lit(0.0)))
        part = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        order = part.orderBy("ratio", level)
        before = F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("full", before + F.col("ratio") * left <= F.col("b"))
        spent = F.sum(F.when(F.col("full"), F.col("c")).otherwise(0)).over(part)
        open_ = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(part)
        share = F.floor((F.col("b") - spent).cast("double") * F.col("w") / F.when(open_ > 0, open_))
        nodes = nodes.withColumn("grant", F.when(F.col("full"), F.col("c")).otherwise(F.least(share.cast("long"), F.col("c"))))
        out = out.drop("grant").join(nodes.select(*here, "grant"), here)
    return out


def mix(
    docs: DataFrame,
    *,
    levels: dict[str, str],
    weights: dict[str, dict[str, int]],
    share: float = 0.5,
    max_epochs: int = 2,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """``docs`` with ``mix_tokens``, ``mix_copies`` (how often the mixture holds it, 0 and up).

    ``levels`` names the tree's levels from the root and gives their values as
    SQL expressions over ``docs`` (null counts as ''). The budget is ``share`` of all
    tokens. Documents without tokens are never taken. Rows that repeat an id
    have the same place in an order and go or stay together. A null id orders
    as the id ''. Columns named ``mix_...`` are replaced, an empty table stays
    empty, and a text counts with its whole length.
    """
    names = [f"mix_{k}" for k in levels]
    rows = docs.drop("mix_tokens", "mix_copies", *names)
    own = rows.columns
    rows = rows.withColumns({f"mix_{k}": F.coalesce(F.expr(c).cast("string"), F.lit("")) for k, c in levels.items()} | {"mix_tokens": tokens_of(F.col(text_col))})
    slim = rows.select(F.col(id_col).alias("id"), *names, F.col("mix_tokens").alias("tokens")).where("tokens > 0")
    leaves = slim.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), (F.sum("tokens") * max_epochs).alias("cap"))
    leaves = settle(leaves, "leaves")
    total = leaves.agg(F.sum("tokens").alias("t"), F.max("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    budget = F.lit(int(math.floor((total.t or 0) * share)))
    granted = allocate(leaves, names, {f"mix_{k}": v for k, v in weights.items()}, budget)
    epoch, rest = F.floor(F.col("grant") / F.col("tokens")), F.col("grant") % F.col("tokens")
    granted = settle(granted.select(*names, epoch.cast("int").alias("epochs"), rest.alias("rest")), "grants")
    spread = F.broadcast if total.k <= broadcast_rows else (lambda df: df)

    def place(id_: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))

    digits = max(1, math.ceil(math.log(max((total.n or 1) / 1000, 1), 16)))
    placed = slim.join(spread(granted), names).withColumn("at", place(F.col("id"))).withColumn("bucket", F.substring("at", 1, digits))
    sums = placed.groupBy(*names, "rest", "bucket").agg(F.sum("tokens").alias("s"))
    running = F.sum("s").over(Window.partitionBy(*names).orderBy("bucket"))
    ends = sums.withColumn("upto", running).where("upto > rest").groupBy(*names).agg(F.min("bucket").alias("last"), F.min_by(F.col("upto") - F.col("s"), "bucket").alias("before"))
    ends = settle(ends, "ends")
    tail = placed.join(spread(ends), names).where("bucket = last")
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy(*names).orderBy("at"))
    picked = settle(tail.withColumn("upto", upto).where("upto <= rest").select(F.col("id").alias("_id"), F.lit(True).alias("_hit")).distinct(), "picked")
    chosen = F.broadcast(picked) if picked.count() <= broadcast_rows else picked
    full = rows.join(spread(granted), names, "left").join(spread(ends), names, "left")
    full = full.withColumn("_bucket", F.substring(place(F.col(id_col)), 1, digits)).join(chosen, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    inside = (F.col("_bucket") < F.col("last")) | F.col("_hit")
    copies = F.when(F.col("mix_tokens") > 0, F.coalesce("epochs", F.lit(0)) + F.when(F.coalesce(inside, F.lit(False)) & (F.col("rest") > 0), 1).otherwise(0)).otherwise(0)
    return full.withColumn("mix_copies", copies.cast("int")).select(*[f"`{c}`" for c in own], *names, "mix_tokens", "mix_copies")
