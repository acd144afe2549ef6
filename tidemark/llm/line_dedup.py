"""Fuzzy line dedup by MinHash, in DataFrame expressions alone.

A line's set holds its character shingles of ``width`` characters (UTF-16 code
units) at every position, taken from the trimmed, lower-cased line, as 64-bit
hashes. Every shingle enters the signature: ``2 * ring`` minhashes, paired into
``subs`` sub-keys, and every two sub-keys joined into a band key of four
minhashes. By the default, 12 minhashes make 15 keys, and lines of similarity
0.8, 0.85 and 0.9 share one with probability 0.975, 0.992 and 0.999. A key is
made only where other lines have both of its sub-keys too, for none meets at others.

All lines of a bucket meet its first line, and what that links is merged. In
buckets that still hold lines of several components, every two lines of
different ones are decided: one by one in buckets of up to ``whole_bucket``, and
for the lines of larger ones by an exact set join. Of two sets that reach the
similarity, the rarest shingles share one, in places that leave room for the
overlap; no line, pair or bucket is left out, and a family of n variants makes
pairs only where rare shingles agree. So two close lines that share a key end in
one component, whatever the bucket's size.

A pair is dropped early only where the shingles' bitmaps prove that too many
are in one line alone; all others are confirmed by the exact Jaccard similarity
of the whole sets. Links are merged by distributed union-find, and of each
component only the first line in (document, position) order stays. A line of
under ``width`` characters repeats only exactly.

A line met in many documents is one row from the first aggregation on, which
signs lines where they are read and sends minhashes, not texts. Shingles are
signed by generated code, a few positions a row; only lines that share a bucket
get sets.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_driver, settle
from .components import components


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def _mask(i: int) -> int:
    """A fixed 64-bit point for minhash ``i`` (signed)."""
    z = (i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & (1 << 64) - 1
    z ^= z >> 31
    return z - (1 << 64) if z >> 63 else z


def shingled(lines: DataFrame, width: int, per: int, line: str = "line") -> DataFrame:
    """Rows of ``per`` hashed shingles ``s0``, ``s1``, ... in place of the line.

    Together they hold the shingle at every position, the last one perhaps
    repeatedly; a line of under ``width`` characters is its only shingle. The
    row that starts the line has ``at`` 1.
    """
    keys = [f"`{c}`" for c in lines.columns if c != line]
    units = lines.select(*keys, F.encode(line, "UTF-16BE").alias("_u"))
    last = F.greatest(F.length("_u") - (2 * width - 1), F.lit(1))
    rows = units.select(*keys, "_u", last.alias("_last")).select(*keys, "_u", "_last", F.explode(F.sequence(F.lit(1), F.col("_last"), F.lit(2 * per))).alias("at"))
    place = lambda k: F.least(F.col("at") + 2 * k, F.col("_last"))
    return rows.select(*keys, "at", *[F.xxhash64(F.substring("_u", place(k), F.lit(2 * width))).alias(f"s{k}") for k in range(per)])


def signed(lines: DataFrame, width: int, subs: int, per: int = 24) -> DataFrame:
    """(h, g, doc, n, long, b0, b1, ...) of each line of ``lines`` (h, g, doc, line).

    ``doc`` is its first document, ``n`` how often it stands in ``lines``,
    ``long`` whether it has ``width`` code units, and the rest are sub-keys. A
    minhash is the least xor distance of a shingle to a fixed point.
    """
    near = lambda i: F.min(F.least(*[F.col(f"s{k}").bitwiseXOR(F.lit(_mask(i))) for k in range(per)]))
    # in code units, as shingles are: fewer characters than ``width`` may have more of them
    long = (F.length("line") >= width) | (F.length(F.encode("line", "UTF-16BE")) >= 2 * width)
    rows = shingled(lines.select("h", "g", "doc", long.alias("long"), "line"), width, per)
    low = rows.groupBy("h", "g").agg(F.min("doc").alias("doc"), F.sum(F.when(F.col("at") == 1, 1).otherwise(0)).alias("n"), F.max("long").alias("long"), *[near(i).alias(f"_m{i}") for i in range(2 * subs)])
    return low.select("h", "g", "doc", "n", "long", *[F.xxhash64(F.lit(i), f"_m{2 * i}", f"_m{2 * i + 1}").alias(f"b{i}") for i in range(subs)])


def sketched(lines: DataFrame, width: int, words: int = 32, per: int = 16) -> DataFrame:
    """``lines`` (lid, line) with ``most``, a bound of the set's size, and a bitmap ``w0``, ``w1``, ... of its hashes."""
    bits = [c for k in range(per) for c in (F.expr(f"s{k} >>> 6 & {words - 1}").alias(f"i{k}"), F.expr(f"shiftleft(1L, cast(s{k} & 63 as int))").alias(f"b{k}"))]
    hashed = shingled(lines.select("lid", "line"), width, per).select("lid", *bits)
    word = lambda i: reduce(Column.bitwiseOR, [F.when(F.col(f"i{k}") == i, F.col(f"b{k}")).otherwise(0) for k in range(per)])
    maps = hashed.groupBy("lid").agg(*[F.bit_or(word(i)).alias(f"w{i}") for i in range(words)])
    units = F.length(F.encode("line", "UTF-16BE")) / 2
    return lines.join(maps, "lid").withColumn("most", F.greatest(units - (width - 1), F.lit(1)).cast("int"))


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, pos, h, g, line): every line that is not blank; null texts have none.

    ``th`` is a hash of the text, so that rows of one id with several texts
    stay apart; ``h`` and ``g`` are 128 bits naming the normalized line.
    """
    # the text is hashed before it is split, else once a line; no line is blank by its case
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("_text"))
    lines = texts.select("doc", "th", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "raw")).where(F.trim("raw") != "")
    lines = lines.select("doc", "th", "pos", normal(F.col("raw")).alias("line"))
    return lines.select("doc", "th", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("line"), "line").alias("g"), "line")


def probable(pairs: DataFrame, texts: DataFrame, similarity: float, words: int = 32) -> DataFrame:
    """The pairs (a, b, off) but for those whose bitmaps prove them too far apart; ``off`` is less for closer bitmaps.

    Bits set on one side alone are at most the elements on one side alone, and
    at the similarity those are at most (1 - s) / (1 + s) of both sizes.
    """
    side = lambda x: texts.select(F.col("lid").alias(x), F.col("most").alias(f"n{x}"), *[F.col(f"w{i}").alias(f"{x}{i}") for i in range(words)])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(words)), F.lit(0))
    off = both.select("a", "b", "na", "nb", apart.alias("_apart")).where(F.col("_apart") * (1 + similarity) <= (F.col("na") + F.col("nb")) * (1 - similarity) + 1e-6)
    return off.select("a", "b", (F.col("_apart") / (F.col("na") + F.col("nb"))).alias("off"))


def hashes(line: Column, width: int) -> Column:
    """Hashed shingles at every position; a shorter line is its only one."""
    # bound as a lambda's variable, the line is encoded once and not once a shingle
    every = lambda u: F.sequence(F.lit(1), F.greatest(F.length(u) - (2 * width - 1), F.lit(1)), F.lit(2))
    one = lambda u: F.transform(every(u), lambda i: F.xxhash64(F.substring(u, i, F.lit(2 * width))))
    return F.get(F.transform(F.array(F.encode(line, "UTF-16BE")), one), 0)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the Jaccard similarity."""
    return exact(probable(pairs, texts, similarity), texts, width, similarity)


def exact(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``confirmed`` without a look at bitmaps; sets are made where a pair meets, for texts travel lighter."""
    side = lambda x: texts.select(F.col("lid").alias(x), F.col("line").alias(f"l{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    sets = both.select("a", "b", hashes(F.col("la"), width).alias("sa"), hashes(F.col("lb"), width).alias("sb"))
    shared, most = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    # the union has at most the rest of the shingles; it is made where that does not decide
    return sets.where((shared * (1 + similarity) >= similarity * most + 1e-6) | (shared >= similarity * F.size(F.array_union("sa", "sb")))).select("a", "b")


def _within(rows: int):
    """A broadcast of frames of at most so many rows; ``bound`` is a settled frame that has as many rows or more."""

    def near(df: DataFrame, bound: DataFrame | None = None) -> DataFrame:
        return F.broadcast(df) if (df if bound is None else bound).count() <= rows else df

    return near


def _members(keyed: DataFrame, near) -> DataFrame:
    """``keyed`` rows of keys with several lines, with the first line a and the number m of lines."""
    buckets = settle(keyed.groupBy("key").agg(F.min("lid").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1"), "line-buckets")
    out = settle(keyed.join(near(buckets), "key").select("key", "lid", "a", "m"), "line-members")
    discard(buckets)
    return out


def _shared_keys(signs: DataFrame, subs: int, near) -> tuple[DataFrame, DataFrame]:
    """A settled frame and, made from it, (lid, key): the keys of ``signs`` (lid, b0, b1, ...) at which lines may meet.

    Lines that share a key share both of its sub-keys; where a sub-key is of one
    line alone, no key is made, so no line that shares a key is left out.
    """
    each = signs.select("lid", F.posexplode(F.array(*[f"b{i}" for i in range(subs)])).alias("i", "b"))
    known = settle(each.groupBy("b").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("b"), "line-subs")
    mine = [F.max(F.when(F.col("i") == i, F.col("b"))).alias(f"b{i}") for i in range(subs)]
    wide = settle(each.join(near(known), "b").groupBy("lid").agg(F.count(F.lit(1)).alias("m"), *mine).where("m > 1").drop("m"), "line-subs", repeats=False)
    discard(known)
    both = lambda i, j: F.col(f"b{i}").isNotNull() & F.col(f"b{j}").isNotNull()
    keys = [F.when(both(i, j), F.xxhash64(F.lit(k), f"b{i}", f"b{j}")) for k, (i, j) in enumerate(combinations(range(subs), 2))]
    return wide, wide.select("lid", F.explode(F.array(*keys)).alias("key")).where("key is not null")


def _all_pairs(met: DataFrame) -> DataFrame:
    """(a, b) of every two lines of a bucket that are of different components c, but for its first line, which all have met."""
    lists = met.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lid", "c"))).alias("ids"))
    pairs = lists.select(F.posexplode("ids").alias("i", "x"), "ids").where("i > 0").select("x", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("y"))
    return pairs.where("x.c != y.c").select(F.col("x.lid").alias("a"), F.col("y.lid").alias("b"))


def heads(lines: DataFrame, width: int, similarity: float, near, words: int = 32, folds: int = 8, back: int = 2) -> DataFrame:
    """(s, lid, n, left, p0, p1, ..., v0, v1, ...): the rarest shingles s of each line of ``lines``, as many as ``set_join`` takes.

    ``n`` is the size of the line's set, ``left`` how many of it are no rarer
    than s, s included, ``p0``, ``p1``, ... are the ``back`` shingles before s
    in the line's rows (where there are fewer, a number no other line has), and
    the rest is the bitmap, folded. One order holds for all lines, and s is a
    shingle's place in it; shingles of one line alone only take places.
    """
    fold = [reduce(Column.bitwiseOR, [F.col(f"w{j}") for j in range(i, words, folds)]).alias(f"v{i}") for i in range(folds)]
    bits = [f"v{i}" for i in range(folds)]
    sets = settle(lines.select("lid", F.array_distinct(hashes(F.col("line"), width)).alias("set"), *fold), "line-sets", repeats=False)
    each = sets.select("lid", F.explode("set").alias("s"))
    often = settle(each.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "line-shingles")
    common = settle(often.orderBy("f", "s").select("s", F.monotonically_increasing_id().alias("r")), "line-places")
    ranked = each.join(near(common), "s").groupBy("lid").agg(F.sort_array(F.collect_list("r")).alias("common"))
    ranked = ranked.join(sets.select("lid", F.size("set").alias("n"), *bits), "lid")
    head = F.slice("common", F.lit(1), F.greatest(F.floor(F.size("common") - similarity * F.col("n") + 1e-6).cast("int") + 1, F.lit(0)))
    ranked = ranked.select("lid", "n", *bits, F.size("common").alias("_m"), head.alias("_head"))
    ranked = ranked.select("lid", "n", *bits, "_m", "_head", F.posexplode("_head").alias("_k", "s"))
    before = [F.coalesce(F.get("_head", F.col("_k") - (i + 1)), -1 - F.col("lid")).alias(f"p{i}") for i in range(back)]
    ranked = ranked.select("s", "lid", "n", (F.col("_m") - F.col("_k")).alias("left"), *before, *bits)
    out = settle(ranked.where(F.col("left") >= similarity * F.col("n") - 1e-6), "line-heads", repeats=False)
    discard(sets, often, common)
    return out


def crowded(head: DataFrame, similarity: float, meetings: int = 64) -> bool:
    """Whether rows of ``heads`` meet more than so many rows each, on average, in a ``set_join`` without ``first``."""
    pivot = F.when(F.col("left") * (1 + similarity) >= 2 * similarity * F.col("n") - 1e-6, 1).otherwise(0)
    each = head.groupBy("s").agg(F.count(F.lit(1)).alias("rows"), F.sum(pivot).alias("pivots"))
    rows, met = each.agg(F.sum("rows"), F.sum(F.col("rows").cast("double") * F.col("pivots"))).first()
    return bool(rows) and met > meetings * rows


def _meetings(few: DataFrame, rows: DataFrame, similarity: float, first: bool) -> DataFrame:
    """(a, b) of the rows that meet in a ``set_join``; a pair may come repeatedly."""
    bits, before = ([c for c in rows.columns if c.startswith(p)] for p in "vp")
    x, y = lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")
    both = x("n") + y("n")
    apart = sum((F.bit_count(x(v).bitwiseXOR(y(v))) for v in bits), F.lit(0))
    fits = (x("s") == y("s")) & (x("c") != y("c")) & (F.least(x("left"), y("left")) * (1 + similarity) >= similarity * both - 1e-6)
    if not first:
        fits &= (x("n") < y("n")) | (x("n") == y("n")) & (x("lid") < y("lid"))
        fits = reduce(Column.__and__, [x(p) != y(q) for p in before for q in before], fits)
    fits &= apart * (1 + similarity) <= both * (1 - similarity) + 1e-6
    met = rows.alias("y").join(few.alias("x"), fits)
    return met.select(F.least(x("lid"), y("lid")).alias("a"), F.greatest(x("lid"), y("lid")).alias("b"))


def set_join(head: DataFrame, member: DataFrame, similarity: float, near, first: bool = False, folds: int = 8) -> DataFrame:
    """(a, b) of lines of ``heads`` in different components: all that reach the similarity, and some that do not.

    Two sets of sizes m <= n that share k shingles share one of the m - k + 1
    rarest of one and the n - k + 1 rarest of the other, and of both k are no
    rarer than the rarest they share. Here k is at least s / (1 + s) * (m + n),
    hence at least s * n, and 2 * s / (1 + s) * m. Bitmaps rule out as in
    ``probable``. With ``first``, only pairs with one of up to four lines of
    each shingle: they link most of a family without all its pairs. Without it
    two lines do not meet at s where they have met before: if one of the last
    shingles before s is the same, they share a rarer row, which any of these
    bounds lets pass if it lets s pass. So at the rarest row they share they meet.
    """
    bits, before = [f"v{i}" for i in range(folds)], [c for c in head.columns if c.startswith("p")]
    of = head.select("s", "lid").join(near(member), F.col("lid") == F.col("node"), "left").select("s", "lid", F.coalesce("component", "lid").alias("c"))
    mixed = settle(of.groupBy("s").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo != _hi").select("s"), "line-mixed")
    rows = head.join(near(mixed), "s").join(near(member), F.col("lid") == F.col("node"), "left")
    rows = settle(rows.select("s", "lid", "n", "left", F.coalesce("component", "lid").alias("c"), *before, *bits), "line-rows", repeats=False)
    some = F.array_distinct(F.array(F.min("lid"), F.max("lid"), F.min_by("lid", F.xxhash64("lid")), F.max_by("lid", F.xxhash64("lid"))))
    few = rows.join(near(rows.groupBy("s").agg(some.alias("_some")).select("s", F.explode("_some").alias("lid")), rows), ["s", "lid"]) if first else rows.where(F.col("left") * (1 + similarity) >= 2 * similarity * F.col("n") - 1e-6)
    pairs = settle(_meetings(near(few, rows), rows, similarity, first).distinct(), "line-pairs")
    discard(mixed, rows)
    return pairs


def _joined(member: DataFrame, links: DataFrame, near) -> DataFrame:
    """The components (node, component) of ``member`` with ``links`` (a, b) added, by links between components."""
    of = lambda x: near(member).select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    roots = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    top = settle(components(roots.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "line-tops")
    old = member.join(near(top.select(F.col("node").alias("component"), F.col("component").alias("_top")), top), "component", "left")
    out = old.select("node", F.coalesce("_top", "component").alias("component")).union(top.join(near(member.select("node"), member), "node", "left_anti"))
    out = settle(out, "line-components")
    discard(top)
    return out


def dropped_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 8,
    similarity: float = 0.8,
    subs: int = 6,
    whole_bucket: int = 8,
    broadcast_bytes: int = 64 << 20,
    spare_driver: bool = False,
) -> DataFrame:
    """(doc, th, pos, component, kept_doc) of every line that goes; ``th`` is ``xxhash64`` of the line's text.

    Blank lines always stay. Ties go to the smaller (document, position); rows
    of one id are one document, so a repeated row loses the lines its twin
    loses and another text of the id loses its own. Rows with a null id or text
    keep all their lines, an empty table loses none, and a text may be one line
    of any length. Columns other than the two named are not read.
    What is small is broadcast, up to ``broadcast_bytes`` at 64 bytes a row;
    the rest is joined by shuffles. With ``spare_driver`` all keys are made, and
    of shorter rows, in fewer jobs with less to broadcast, for more CPU seconds;
    the lines that meet are the same.
    """
    near = _within(broadcast_bytes // 64)
    docs = docs.where(F.col(id_col).isNotNull())
    lines = occurrences(docs, id_col, text_col)
    per = {"per": 8} if spare_driver else {}
    once = settle(signed(lines, width, subs, **per).select(F.monotonically_increasing_id().alias("lid"), "*"), "line-keys", repeats=False)
    free_driver(docs)
    if spare_driver:
        keys = [F.xxhash64(F.lit(k), f"b{i}", f"b{j}") for k, (i, j) in enumerate(combinations(range(subs), 2))]
        shares, keyed = None, once.where("long").select("lid", F.explode(F.array(*keys)).alias("key"))
    else:
        shares, keyed = _shared_keys(once.where("long"), subs, near)
        free_driver(docs)
    met = _members(keyed, near)
    discard(shares)
    shared = settle(met.select("lid").distinct(), "line-wanted")
    wanted = settle(once.select("lid", "h", "g", "doc").join(near(shared), "lid"), "line-wanted")
    some = docs.join(near(wanted.select(F.col("doc").alias("_doc")).distinct(), wanted), F.col(id_col) == F.col("_doc"), "left_semi")
    texts = occurrences(some, id_col, text_col).join(near(wanted), ["h", "g", "doc"]).select("lid", "line").dropDuplicates(["lid"])
    texts = settle(sketched(settle(texts, "line-texts", repeats=False), width, **per), "line-sketches", repeats=False)
    free_driver(docs)
    star = met.where("a != lid").select("a", F.col("lid").alias("b"))
    star = settle(star.distinct(), "line-star")
    links = settle(confirmed(star, texts, width, similarity), "line-links")
    free_driver(docs)
    member = settle(components(links), "line-components")
    free_driver(docs)
    used = []

    def keep_used(df: DataFrame, name: str, repeats: bool = True) -> DataFrame:
        used.append(settle(df, name, repeats))
        return used[-1]

    def placed(members: DataFrame) -> DataFrame:
        rows = members.where("m > 2").join(near(member), F.col("lid") == F.col("node"), "left")
        return keep_used(rows.select("key", "lid", "m", F.coalesce("component", "lid").alias("c")), "line-placed")

    def merged(pairs: DataFrame) -> DataFrame:
        more = keep_used(exact(pairs, texts, width, similarity), "line-links")
        if not more.limit(1).count():
            return member
        used.append(_joined(member, more, near))
        return used[-1]

    def apart(pairs: DataFrame) -> DataFrame:
        of = lambda x: near(member).select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    members = placed(met)
    mixed = keep_used(members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key"), "line-mixed")
    undecided = keep_used(members.join(near(mixed), "key"), "line-undecided")
    texts, every = keep_used(texts.join(near(undecided.select("lid").distinct(), undecided), "lid"), "line-doubted", repeats=False), texts
    large = keep_used(undecided.where(F.col("m") > whole_bucket).select("lid").distinct(), "line-large")
    rest = keep_used(_all_pairs(undecided.where(F.col("m") <= whole_bucket)).distinct(), "line-pairs")
    free_driver(docs)
    member = merged(probable(rest, texts, similarity))
    free_driver(docs)
    if large.limit(1).count():
        head = heads(texts.join(near(large), "lid"), width, similarity, near)
        used.append(head)
        # the second join finds all; after the first one the lines of a large family are of one component and meet no more
        for first in (True, False) if crowded(head, similarity) else (False,):
            free_driver(docs)
            used.append(set_join(head, member, similarity, near, first))
            free_driver(docs)
            likely = keep_used(probable(used[-1], texts, similarity), "line-likely")
            # one pair of each line, the closest by its bitmaps, then all that are still apart
            member = merged(likely.groupBy("b").agg(F.min_by("a", F.struct("off", "a")).alias("a")))
            free_driver(docs)
            member = merged(apart(likely))
            free_driver(docs)
    grouped = once.select("lid", "h", "g", "doc", "n").join(near(member), F.col("lid") == F.col("node"), "left")
    repeated = grouped.where("component is not null or n > 1").select("h", "g", "doc", F.coalesce("component", "lid").alias("component"))
    repeated = settle(repeated, "line-groups")
    # both sides as written tables: adaptive execution can then split a component that holds most lines
    keep = settle(repeated.groupBy("component").agg(F.min("doc").alias("kept_doc")), "line-keepers")
    decided = settle(repeated.select("h", "g", "component").join(near(keep), "component"), "line-decided")
    free_driver(docs)
    met_again = lines.select("doc", "th", "pos", "h", "g").join(near(decided), ["h", "g"])
    own = met_again.groupBy("doc", "th", "component", "kept_doc").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    lost = F.when(F.col("doc") == F.col("kept_doc"), F.expr("slice(at, 2, size(at))")).otherwise(F.col("at"))
    gone = settle(own.select("doc", "th", F.explode(lost).alias("pos"), "component", "kept_doc"), "lines-gone")
    discard(once, met, shared, wanted, every, star, links, member, repeated, keep, decided, *used)
    free_driver(docs)
    return gone


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False, broadcast_bytes: int = 64 << 20, **options) -> DataFrame:
    """``docs`` with near-duplicate lines taken out of the text, plus ``lines_dropped`` (long).

    Null texts stay null and empty ones empty; an empty table stays so. A
    document that loses every line it had has an empty text, or goes with
    ``drop_emptied``. Other columns pass through; a column named
    ``lines_dropped`` is replaced.
    """
    found = dropped_lines(docs, id_col=id_col, text_col=text_col, broadcast_bytes=broadcast_bytes, **options)
    gone = found.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("_gone"))
    rest = docs.drop("lines_dropped")
    names = rest.columns
    gone = settle(gone, "lines-gone")
    near = F.broadcast(gone) if 64 * gone.count() + 8 * found.count() <= broadcast_bytes else gone
    discard(found)
    joined = rest.join(near, (F.col(id_col) == F.col("_doc")) & (F.xxhash64(text_col) == F.col("_th")), "left")
    lost = F.col("_gone").isNotNull()
    # bound as a lambda's variable, the lines are split once and not once a line
    every = F.array(F.split(F.col(text_col), "\n", -1))
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    rest_of = lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n")
    text = F.when(lost, F.get(F.transform(every, rest_of), 0)).otherwise(F.col(text_col))
    out = joined.withColumn("lines_dropped", F.when(lost, F.size("_gone")).otherwise(0).cast("long")).withColumn(text_col, text)
    if drop_emptied:
        out = out.where((F.col("lines_dropped") == 0) | (F.trim(F.translate(F.col(text_col), "\n", " ")) != ""))
    return out.select(*[f"`{n}`" for n in names], "lines_dropped")
