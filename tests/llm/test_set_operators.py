"""WARC, nearest neighbours, near-dedup, line dedup, mixing: brute force, round trips and edge cases."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup as L
from tidemark.llm import minhash as M
from tidemark.llm import mixing as X
from tidemark.llm import nn_descent as N
from tidemark.llm import warc as W
from tidemark.llm.common import new_path
from tidemark.llm.components import components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc_round_trip(spark):
    html = "<p>" + "x" * 200
    rows = [(3, "http://a/", html), (1, None, html), (2, "http://b/\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "é" * 50), (8, "u", "é" * 50), (9, "u", "z" * 500_000), (None, "u", html), (1, None, html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = W.archive(pages)
    got = W.summary(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (dict((a, c) for a, _, c in rows)[r.page_id] or "").encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()
        first = min(a for a, _, c in rows if (c or "").encode() == raw and a is not None)
        revisit = len(raw) >= 100 and r.page_id != first
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
    assert W.read_payloads(spark, path).count() == len({(c or "") for _, _, c in rows})
    for r in W.rebuild(spark, path).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n") and b"X: y" not in head.split(b"\r\n")
        n = int([h for h in head.split(b"\r\n") if h.startswith(b"Content-Length: ")][0].split()[1])
        assert n == len(body) - 4 and (b"revisit" in head) == (n == 0 and bytes(r.payload) != b"")
    empty = W.archive(pages.where("false"))
    assert W.summary(spark, empty).count() == 0


def test_warc_refuses_damage(spark):
    path = new_path(spark, "warc")
    W.write(spark.createDataFrame([(1, "u", "a" * 150)], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).write.parquet(f"{path}/other")
    from tidemark.llm.common import new_path as fresh

    damaged = fresh(spark, "warc")
    spark.read.parquet(f"{path}/records").write.parquet(f"{damaged}/records")
    spark.read.parquet(f"{path}/other").write.parquet(f"{damaged}/payloads")
    assert [(r.payload_bytes, r.payload_digest) for r in W.summary(spark, damaged).collect()] == [(None, None)]


def test_warc_urls_cannot_forge_headers(spark):
    forged = "\u2028WARC-Payload-Digest: sha256:" + "a" * 64 + "\u2028WARC-Refers-To: <urn:page:77>\u0085WARC-Type: revisit\r\nWARC-Refers-To: <urn:page:78>\r\n"
    rows = [(1, "http://a/" + forged, "x" * 200), (2, forged, "y"), (3, None, "y"), (4, "urn:none", "y"), (5, "", "y"), (6, "http://é/a%0Ab c", "y")]
    path = W.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in W.summary(spark, path).collect()}
    for i, _, html in rows:
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(html), hashlib.sha256(html.encode()).hexdigest(), "response", None)
    urls = {r.page_id: r.url for r in W.read_records(spark, path).collect()}
    assert (urls[3], urls[4], urls[5], urls[6]) == (None, "urn:none", "", rows[5][1])
    assert urls[2].startswith("%E2%80%A8WARC-Payload-Digest") and urls[2].endswith("%0D%0A") and not set(urls[2]) & set(W.CONTROLS)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((600, 16)).astype(np.float32)
    v[100:300] = v[0]
    rows = [(i, v[i].tolist(), "x") for i in range(600)]
    rows += [(1000, None, "x"), (1050, [0.0] * 16, "x"), (1001, [float("nan")] * 16, "x"), (1002, [1.0, None] + [0.0] * 14, "x"), (1003, [float("inf")] * 16, "x"), (None, v[0].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in N.search(df, every=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 50))
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    for q, found in got.items():
        found.sort()
        s = u @ u[q]
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(f[2] == pytest.approx(s[f[1]], abs=1e-12) for f in found)
        if q in (0, 100, 150):
            assert [f[1] for f in found] == best
        hit += len({f[1] for f in found} & set(best))
    assert hit / (5 * len(got)) >= 0.9
    few = N.search(df.where("vec_id in (0, 50, 51)"), every=50).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2), (50, 1), (50, 2)]
    assert N.search(df.where("false"), every=50).count() == 0


def test_nearest_neighbours_of_one_class(spark):
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in (0, 1, 2, 50)], "vec_id long, embedding array<float>")
    got = N.search(equal, every=50).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert all(r.score == pytest.approx(1) for r in got)
    assert N.search(equal.where("vec_id = 0"), every=50).count() == 0


def test_nearest_neighbours_of_odd_rows(spark):
    """Repeated ids are one candidate, other lengths take no part, extreme components have cosines."""
    rows = [(50, [1.0, 0.0]), (7, [1.0, 0.1]), (7, [1.0, 0.2]), (7, [1.0, 0.2]), (8, [1.0, 0.3]), (9, [1e-200, 0.0]), (10, [0.0, 1e200]), (11, [1.0]), (12, [1.0, 0.0, 0.0]), (50, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash")).withColumn("node", F.lit(1))
    for _ in range(2):
        got = N.search(df, every=50).orderBy("rank").collect()
        assert [(r.query_id, r.vec_id) for r in got] == [(50, 9), (50, 7), (50, 8), (50, 10)]
        assert got[0].score == pytest.approx(1) and got[3].score == pytest.approx(0, abs=1e-12)


def test_nearest_neighbours_recall_on_the_table(spark):
    """The registered search against brute force, on the whole table and with hubs that are split."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None]
    rows = [(i, np.asarray(v, np.float64)) for i, v in rows if all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, u = np.array([i for i, _ in rows]), np.stack([v / np.linalg.norm(v) for _, v in rows])
    for options in ({}, {"fan": 50}):
        hit = n = 0
        got = {}
        for r in N.search(df, every=50, **options).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        for q in np.flatnonzero(ids % 50 == 0):
            s = u @ u[q]
            s[q] = -2
            best = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:5]
            hit, n = hit + len({int(ids[i]) for i in best} & got[ids[q]]), n + 5
        assert hit >= 0.9 * n, options


def brute_groups(rows, percent=85):
    words = M.Words()
    sets = {i: M.shingle_set(t.encode() if t is not None else None, words) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(rng, n, base_words, edits):
    base = [f"w{rng.randint(0, 10_000)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10_000)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [2048, 8])
def test_near_duplicates_match_brute_force(spark, block):
    rng = random.Random(8)
    texts = near_copies(rng, 60, 100, 3) + near_copies(rng, 20, 40, 1) + ["a b c d", "A b\tc d", "a b c", "x" * 200_000, None, "", " \n", "same text of five words"] + ["same text of five words"] * 30
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("keys", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(df, block=block).collect()}
    assert got == brute_groups(rows)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(M, "BLOCK_BYTES", 20_000)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(df, block=block).collect()} == got
    twice = M.near_duplicates(df.union(df), block=block)
    assert twice.count() == 2 * len(rows) and twice.where("kept").select("doc_id").distinct().count() == len({c for _, c in got.values()})


def test_near_duplicates_in_large_buckets(spark):
    """Pairs of a template family whose other members are too far apart to connect them."""
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10_000)}" for _ in range(200)]
    texts = []
    for i in range(100):
        member = list(base)
        for at in range(3):
            member[60 * at + rng.randrange(55)] = f"m{i}"
        twin = list(member)
        twin[rng.randrange(200)] = f"t{i}"
        texts += [" ".join(member), " ".join(twin)]
    rows = list(enumerate(texts))
    want = brute_groups(rows)
    assert len({c for _, c in want.values()}) == 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(df, block=2, halves=4, margin=0.02).collect()}
    assert got == want


def test_similar_in_parts(monkeypatch):
    """Intersections counted a few entries at a time are those of plain sets."""
    rng = random.Random(3)
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(rng.randint(1, 60))], np.uint64)) for _ in range(30)]
    index = np.arange(len(sets))
    want = {i: [j for j in index if 100 * len(set(sets[i]) & set(sets[j])) >= 50 * len(set(sets[i]) | set(sets[j]))] for i in index}
    for hits in (1, 7, 1 << 20):
        monkeypatch.setattr(M, "HITS", hits)
        assert {i: near.tolist() for i, near in M.similar(sets, index, index, 50)} == want


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    rows = {r.doc_id: r for r in M.near_duplicates(df).collect()}
    assert rows[None].kept and rows[None].component_id is None and rows[2].component_id == 2
    assert M.near_duplicates(df.where("false")).count() == 0
    assert M.keep_one(spark.createDataFrame([(1, "x y"), (2, "X y"), (3, "z")], "doc_id long, text string")).count() == 2


def test_line_dedup(spark):
    long = "the quick brown fox jumps over the lazy dog and then it runs into the forest for a long while because of the coming rain in october"
    rows = [
        (1, f"{long}\nunique one\n\nshared", "a"), (2, f"{long} x\nshared\nunique two", "b"), (3, "SHARED ", "c"), (4, None, None), (5, "", "d"), (6, "shared\nown\nown", "e"), (6, "shared\nown\nown", "e"),
        (7, "y" * 150_000, "f"), (None, "shared", "g"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines_dropped string").withColumn("pos", F.lit(1)).withColumn("doc", F.lit(2))
    got = {r.doc_id: r for r in L.dedup_lines(df).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "unique two" and got[2].lines_dropped == 2
    assert got[3].text == "" and got[4].text is None and got[5].text == "" and got[6].text == "own" and got[7].lines_dropped == 0 and got[None].text == "shared"
    left = L.dedup_lines(df, drop_emptied=True)
    assert left.count() == len(rows) - 1 and left.columns[:2] == ["doc_id", "text"]
    assert L.dedup_lines(df.where("false")).count() == 0


def test_sub_keys_are_minhashes(spark):
    """Sub-keys are those of plain minimum xor distances over the shingles at every position."""
    rng = random.Random(9)
    lines = ["".join(rng.choice("abcdé ✓𝄞") for _ in range(n)) for n in (3, 8, 9, 15, 16, 17, 40, 200)]
    units = [x.encode("utf-16-be") for x in lines]
    parts = [(i, u[2 * k : 2 * k + 16]) for i, u in enumerate(units) for k in range(max(1, len(u) // 2 - 7))]
    hashed = spark.createDataFrame(parts, "id int, part binary").select("id", F.xxhash64("part").alias("h")).collect()
    low = [(i, [min(r.h ^ L._mask(k) for r in hashed if r.id == i) for k in range(6)]) for i in range(len(lines))]
    plain = [F.xxhash64(F.lit(k), F.get("low", F.lit(2 * k)), F.get("low", F.lit(2 * k + 1))).alias(f"b{k}") for k in range(3)]
    want = spark.createDataFrame(low, "id int, low array<long>").select("id", *plain)
    once = spark.createDataFrame([(i, 0, 7 - k, x) for i, x in enumerate(lines) for k in range(1 + i % 2)], "h long, g long, doc long, line string")
    got = L.signed(once, 8, 3).collect()
    assert sorted((r.h, r.b0, r.b1, r.b2) for r in got) == sorted(tuple(r) for r in want.collect())
    assert sorted((r.h, r.doc, r.n, r.long) for r in got) == [(i, 7 - i % 2, 1 + i % 2, len(x) >= 8) for i, x in enumerate(lines)]


def test_bitmaps_prove_only_what_is_true(spark):
    """No pair that reaches the similarity is dropped by its bitmaps, and most others are."""
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 999)}" for _ in range(60)]
    lines = []
    for i in range(60):
        copy = list(base)
        for _ in range(i // 2):
            copy[rng.randrange(60)] = f"e{rng.randint(0, 999)}"
        lines.append(" ".join(copy))
    lines += ["ab" * 300, "ab" * 100, "ab" * 40 + "c"]
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    near = {(a, b) for b in range(len(lines)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    texts = L.sketched(spark.createDataFrame(list(enumerate(lines)), "lid long, line string"), 8)
    pairs = spark.createDataFrame([(a, b) for b in range(len(lines)) for a in range(b)], "a long, b long")
    left = {(r.a, r.b) for r in L.probable(pairs, texts, 0.8).collect()}
    assert near <= left and len(left) < 2 * len(near)
    assert {(r.a, r.b) for r in L.confirmed(pairs, texts, 8, 0.8).collect()} == near


def brute_lines(lines, width=8):
    """Which of distinct one-line documents 0, 1, ... go, by plain character shingles."""
    sets = [{x[i : i + width] for i in range(len(x) - width + 1)} or {x} for x in (y.strip().lower() for y in lines)]
    first = list(range(len(lines)))

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                first[max(a, b)] = min(a, b)
    return {i for i in range(len(lines)) if find(i) != i}


def gone_lines(spark, lines, **options):
    return {r.doc for r in L.dropped_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), **options).collect()}


def test_line_sets_read_every_character(spark):
    """Lines that differ only inside or after their last word stay; only close ones go."""
    stem = "image: https://example.com"
    lines = [f"{stem}/cats/alpha-report-2021.html", f"{stem}/dogs/zulu-recipe-1987.pdf", f"{stem}/cats/alpha-report-2022.html"]
    lines += [f"from: x{i:02d}0123456789abcdef{hashlib.sha256(str(i).encode()).hexdigest()}" for i in range(6)]
    lines += [f"read on for more {hashlib.md5(str(i).encode()).hexdigest()}" for i in range(6)]
    plain = "the first of our lines runs over the old fields of corn and into the roots of a large old oak"
    lines += [plain, plain + " x", plain[:50]]
    want = brute_lines(lines)
    assert want == {16}
    assert gone_lines(spark, lines) == want


def test_line_signatures_read_every_line(spark):
    """Near lines meet in any script, without spaces, as digits, and when they are short."""
    lines = []
    for base in (
        "съешь же ещё этих мягких французских булок да выпей чаю у самого синего моря в эту тихую пору",
        "η γρήγορη αλεπού πηδά πάνω από τον τεμπέλη σκύλο και τρέχει μακριά στο σκοτεινό δάσος πριν βρέξει",
        "صباح الخير يا جيراننا الاعزاء نرجو منكم اغلاق الباب الكبير بعد الدخول وعدم ترك الدراجات في الممر",
        "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈剑号巨阙珠称夜光果珍李柰菜重芥姜",
        "1048 2203 9917 4410 3391 7782 5519 6034 8821 1190 4472 9035 2218 7746 3309 5581",
        "9f86d081884b7d659a2beaa0c55ad015a3bf4f1b2b0b822bd15d6c15b0f00a08a94a8be5ccb19ba61c4b8673",
        "many happy days await you",
    ):
        lines += [base, base + "7", base[: len(base) // 2]]
    lines += ["too short", "too short7"]
    want = brute_lines(lines)
    assert want == {1, 4, 7, 10, 13, 16, 19}
    assert gone_lines(spark, lines) == want
    assert gone_lines(spark, lines, broadcast_bytes=0) == want


@pytest.mark.parametrize("whole_bucket", [8, 2])
def test_line_links(spark, whole_bucket):
    """Nothing but true links, and nearly all of them: banding misses few pairs near the threshold."""
    rng = random.Random(2)
    lines = []
    for _ in range(40):
        base = [f"{rng.choice('abcdefgilorux')}word{rng.randint(0, 999)}" for _ in range(60)]
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 4, 20])):
                copy[rng.randrange(60)] = f"e{rng.randint(0, 999)}"
            lines.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r.doc for r in L.dropped_lines(df, whole_bucket=whole_bucket).collect()}
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    truth = {i for i in range(len(lines)) if find(i) != i}
    assert gone <= truth and len(gone) >= 0.97 * len(truth)


def shingle_sets(lines, width=8):
    return [{x[i : i + width] for i in range(len(x) - width + 1)} for x in lines]


def family(rng, n, words=40, spots=10, share=0.3):
    """Variants of one line, many of them near the threshold."""
    base = [f"w{rng.randint(0, 9999)}" for _ in range(words)]
    out = []
    while len(out) < n:
        copy = list(base)
        for i in range(0, words, words // spots):
            if rng.random() < share:
                copy[i] = f"e{i}x{rng.randint(0, 999)}"
        if " ".join(copy) not in out:
            out.append(" ".join(copy))
    return out


def test_set_join_leaves_no_pair_out(spark):
    """All pairs of different components that reach the similarity, but far from all pairs."""
    rng = random.Random(31)
    lines = [x for n in (60, 40) for x in family(rng, n)] + ["ab" * 300, "ab" * 299 + "a", "c" * 40, "lone line with nothing else"]
    sets = shingle_sets(lines)
    near = {(a, b) for b in range(len(lines)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    head = L.heads(L.sketched(spark.createDataFrame(list(enumerate(lines)), "lid long, line string"), 8), 8, 0.8, L._within(1 << 20))
    alone, joined = (spark.createDataFrame([(i, 0) for i in range(n)], "node long, component long") for n in (0, 60))
    apart = {(r.a, r.b) for r in L.set_join(head, alone, 0.8, L._within(1 << 20)).collect()}
    assert len(near) > 30 and near <= apart and len(apart) < len(lines) ** 2 / 4
    assert {p for p in near if max(p) >= 60} <= {(r.a, r.b) for r in L.set_join(head, joined, 0.8, L._within(0)).collect()}
    assert {(r.a, r.b) for r in L.set_join(head, alone, 0.8, L._within(0), first=True).collect()} <= apart


def test_set_join_meets_a_pair_about_once(spark, monkeypatch):
    """A pair comes at the rarest shingle it shares, not at each one; the pairs are the same."""
    rng = random.Random(31)
    lines = [x for n in (60, 40) for x in family(rng, n)]
    rows, meetings, near = [], L._meetings, L._within(1 << 20)

    def counted(*args):
        rows.append(meetings(*args).count())
        return meetings(*args)

    monkeypatch.setattr(L, "_meetings", counted)
    texts = L.sketched(spark.createDataFrame(list(enumerate(lines)), "lid long, line string"), 8)
    alone = spark.createDataFrame([], "node long, component long")
    every, once = ({(r.a, r.b) for r in L.set_join(L.heads(texts, 8, 0.8, near, back=back), alone, 0.8, near).collect()} for back in (0, 2))
    assert every == once
    assert rows[0] > 4 * len(every) and rows[1] < 2 * len(every)


def test_line_dedup_collects_the_drivers_garbage(spark):
    """Line dedup runs jobs by the dozen: the driver's heap is collected between them."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if re.search("Old|MarkSweep", b.getName()))
    before = full()
    assert gone_lines(spark, ["one line of some length", "one line of some lengths", "another"]) == {1}
    assert full() - before >= 5


@pytest.mark.parametrize("whole_bucket,broadcast_bytes", [(8, 64 << 20), (2, 0)])
def test_large_buckets_lose_no_link(spark, whole_bucket, broadcast_bytes):
    """Close lines that share a key are of one component, in buckets of any size."""
    rng = random.Random(8)
    lines = [x for _ in range(2) for x in family(rng, 200)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    subs = {r.doc: [r[f"b{i}"] for i in range(6)] for r in L.signed(L.occurrences(docs, "doc_id", "text"), 8, 6).collect()}
    sets = shingle_sets(lines)
    first = list(range(len(lines)))

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if sum(x == y for x, y in zip(subs[i], subs[j], strict=True)) >= 2 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                first[max(a, b)] = min(a, b)
    gone = gone_lines(spark, lines, whole_bucket=whole_bucket, broadcast_bytes=broadcast_bytes)
    assert {i for i in range(len(lines)) if find(i) != i} <= gone <= brute_lines(lines)


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_keys_are_made_where_lines_may_meet(spark, monkeypatch, broadcast_bytes):
    """No key has a sub-key of one line alone, and no two lines that share a key are kept apart by that."""
    rng = random.Random(12)
    lines = family(rng, 30) + [family(rng, 1)[0] for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    subs = [[r[f"b{i}"] for i in range(6)] for r in L.signed(L.occurrences(docs, "doc_id", "text"), 8, 6).collect()]
    count = Counter(b for line in subs for b in line)
    buckets = Counter((i, j, line[i], line[j]) for line in subs for i, j in combinations(range(6), 2))
    made, members = [], L._members

    def seen(keyed, near):
        made.extend((r.lid, r.key) for r in keyed.collect())
        return members(keyed, near)

    monkeypatch.setattr(L, "_members", seen)
    assert gone_lines(spark, lines, broadcast_bytes=broadcast_bytes) <= brute_lines(lines)
    assert len(made) == len(set(made)) == sum(count[line[i]] > 1 and count[line[j]] > 1 for line in subs for i, j in combinations(range(6), 2)) < 15 * len(lines) / 2
    assert sorted(n for n in Counter(k for _, k in made).values() if n > 1) == sorted(n for n in buckets.values() if n > 1) != []


def test_all_keys_and_shared_keys_drop_the_same_lines(spark):
    """Making every key, which spares the driver jobs and broadcasts, changes no result."""
    rng = random.Random(13)
    lines = family(rng, 6, share=0.1) + [family(rng, 1)[0] for _ in range(10)] + ["short", "short"]
    assert gone_lines(spark, lines, spare_driver=True) == gone_lines(spark, lines) != set()


def test_small_families_are_joined_once(spark, monkeypatch):
    """The join with a few lines of each shingle, which the whole join repeats, runs only where many lines meet."""
    lines, runs, join = family(random.Random(5), 30), [], L.set_join

    def seen(*args):
        runs.append(args[4])
        return join(*args)

    monkeypatch.setattr(L, "set_join", seen)
    assert gone_lines(spark, lines, whole_bucket=2) <= brute_lines(lines) and runs == [False]


def test_components_joined_by_roots(spark):
    """Links added to components give the components of all links."""
    rng = random.Random(6)
    one, two = ([(rng.randrange(60), rng.randrange(60)) for _ in range(25)] for _ in range(2))
    links = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    want = {tuple(r) for r in L.components(links(one + two)).collect()}
    have = L.settle(L.components(links(one)), "have")
    assert {tuple(r) for r in L._joined(have, links([p for p in two if p[0] != p[1]]), L._within(100)).collect()} == want


def test_lines_of_one_id_with_several_texts(spark):
    """A row loses its own repeated lines, not those at the same places in another text of its id."""
    rows = [(1, "a line that is shared by many\nfirst"), (2, "own line here\na line that is shared by many"), (2, "a line that is shared by many\nanother of its lines"), (3, "x\ny\nx")]
    got = sorted((r.doc_id, r.text) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, rows[0][1]), (2, "another of its lines"), (2, "own line here"), (3, "x\ny")]


def test_line_recall_on_documents(spark):
    """Against brute force over all shingles of every line of the table: nine in ten go, and none under the similarity."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    at = {}
    for r in docs.orderBy("doc_id").collect():
        for pos, x in enumerate((r.text or "").split("\n")):
            if x.strip(" "):
                at.setdefault(x.strip(" ").lower(), []).append((r.doc_id, pos))
    lines = list(at)
    sets = [frozenset(x[i : i + 8] for i in range(len(x) - 7)) or frozenset([x]) for x in lines]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    first = list(range(len(lines)))

    def find(x):
        while first[x] != x:
            first[x] = first[first[x]]
            x = first[x]
        return x

    for i, s in enumerate(sets):
        # of two close sets, one of the (1 - similarity) rarest elements is shared
        rare = sorted(s, key=lambda g: (len(holders[g]), g))[: int(0.2 * len(s) + 1e-9) + 1]
        for j in {j for g in rare for j in holders[g] if j < i}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                a, b = find(i), find(j)
                first[max(a, b)] = min(a, b)
    group = {}
    for i in range(len(lines)):
        group.setdefault(find(i), []).extend(at[lines[i]])
    want = {p for ps in group.values() for p in ps if p != min(ps)}
    fuzzy = want - {p for ps in at.values() for p in ps if p != min(ps)}
    got = {(r.doc, r.pos) for r in L.dropped_lines(docs).collect()}
    assert len(fuzzy) > 50 and got <= want and len(fuzzy & got) >= 0.9 * len(fuzzy)


def brute_fill(caps, weights, budget):
    """Water filling by rounds."""
    grant, left = dict.fromkeys(caps, 0), budget
    live = {k for k in caps if weights.get(k, 1) > 0 and caps[k] > 0}
    while live:
        total = sum(weights.get(k, 1) for k in live)
        full = [k for k in live if caps[k] <= left * weights.get(k, 1) / total]
        if not full:
            for k in live:
                grant[k] = min(caps[k], int(left * weights.get(k, 1) / total))
            break
        for k in full:
            grant[k] = caps[k]
            live.discard(k)
        left -= sum(caps[k] for k in full)
    return grant


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 400), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3"])) for i in range(400)] + [(1000, None, "en", "s1"), (1001, "", "fr", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit("clash")).withColumn("mix_lang", F.lit("clash"))
    weights = {"lang": {"en": 5}, "source": {"s1": 3, "s2": 0}}
    out = X.mix(df, levels={"lang": "lang", "source": "source"}, weights=weights, share=0.4, max_epochs=2).collect()
    assert len(out) == len(rows)
    tokens = {r[0]: (len(r[1] or "") + 3) // 4 for r in rows}
    leaf = {r[0]: (r[2] or "", r[3]) for r in rows}
    caps = {}
    for i, k in leaf.items():
        caps[k] = caps.get(k, 0) + 2 * tokens[i]
    top = {}
    for (lang, source), c in caps.items():
        top[lang] = top.get(lang, 0) + c * (source != "s2")  # what has weight 0 can take nothing
    first = brute_fill(top, weights["lang"], int(sum(tokens.values()) * 0.4))
    taken = {}
    for r in out:
        assert r.mix_tokens == tokens[r.doc_id] and 0 <= r.mix_copies <= 2 and (tokens[r.doc_id] or not r.mix_copies)
        taken[leaf[r.doc_id]] = taken.get(leaf[r.doc_id], 0) + r.mix_copies * tokens[r.doc_id]
    for lang in first:
        grants = brute_fill({s: c for (g, s), c in caps.items() if g == lang}, weights["source"], first[lang])
        for source, g in grants.items():
            assert g - 100 <= taken[lang, source] <= g, (lang, source)
    again = X.mix(df, levels={"lang": "lang", "source": "source"}, weights=weights, share=0.4, max_epochs=2)
    assert sorted((r.doc_id, r.mix_copies) for r in again.collect()) == sorted((r.doc_id, r.mix_copies) for r in out)
    assert X.mix(df.where("false"), levels={"lang": "lang"}, weights={}).count() == 0


def test_mixing_passes_budget_by_what_may_be_taken(spark):
    """A language whose only source has weight 0 leaves its budget to its sibling; repeats and long texts count whole."""
    rows = [(i, "x" * 4000, lang, f"{lang}-s") for lang, at in (("de", 0), ("en", 100)) for i in range(at, at + 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    levels = {"lang": "lang", "source": "source"}
    out = X.mix(df, levels=levels, weights={"source": {"de-s": 0}}, share=0.4, max_epochs=1).collect()
    assert sum(r.mix_copies * r.mix_tokens for r in out if r.lang == "en") == 4000 and not any(r.mix_copies for r in out if r.lang == "de")
    twice = X.mix(df.union(df), levels=levels, weights={}, share=0.5, max_epochs=1).collect()
    assert len(twice) == 20 and all(len({r.mix_copies for r in twice if r.doc_id == i}) == 1 for i, *_ in rows)
    long = spark.createDataFrame([(1, "y" * 2_000_001, "en", "s")], "doc_id long, text string, lang string, source string")
    assert [(r.mix_tokens, r.mix_copies) for r in X.mix(long, levels=levels, weights={}, share=1.0).collect()] == [(500_001, 1)]
