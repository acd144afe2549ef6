"""The pipeline's stages on the small tables and on odd rows, and the registered SQL."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_set_operators import brute_groups, brute_lines, family
from tests.llm.test_text_operators import brute_hits
from tests.oracle import compare, connection
from tidemark.llm import common, langid, queries

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def brute_dedup(rows, width=8):
    """Texts by id after line dedup over exact sets of shingles, without documents that lost every line."""
    at = {}
    for i, text in sorted((i, t) for i, t in rows if t is not None):
        for pos, raw in enumerate(text.split("\n")):
            x = raw.strip(" ").lower()
            if x:
                at.setdefault(x, []).append((i, pos))
    lines = list(at)
    sets = [frozenset(x[k : k + width] for k in range(len(x) - width + 1)) or frozenset([x]) for x in lines]
    first = list(range(len(lines)))

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                first[max(x, y)] = min(x, y)
    group = {}
    for k, x in enumerate(lines):
        group.setdefault(find(k), []).extend(at[x])
    gone = {p for ps in group.values() for p in ps if p != min(ps)}
    out = {}
    for i, text in rows:
        parts = text.split("\n") if text is not None else []
        left = [x for pos, x in enumerate(parts) if (i, pos) not in gone]
        if text is None or len(left) == len(parts) or "".join(left).strip(" ") != "":
            out[i] = "\n".join(left) if text is not None else None
    return out


def test_stages_match_brute_force(spark):
    """Each stage of the pipeline, on what the stages before it kept, beside a plain Python version."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = sorted(docs.columns)
    rows = {r.doc_id: r for r in docs.collect()}

    out = STAGES["language ID"](spark, docs, SF).cache()
    net = langid.train(*langid.sample(docs, id_col="doc_id", text_col="text", lang_col="lang", held_mod=4, held_rem=2))
    ids = sorted(rows)
    judged = dict(zip(ids, langid.predict(net, [rows[i].text for i in ids]), strict=True))
    assert {r.doc_id for r in out.collect()} == {i for i in ids if judged[i][0] != "und" and judged[i][1] >= 0.5}
    docs = out

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = STAGES["line dedup"](spark, docs, SF).cache()
    got, want = {r.doc_id: r.text for r in out.collect()}, brute_dedup(rows)
    assert set(want) <= set(got)
    same = sum(got[i] == want[i] for i in want)
    # banding misses few lines near the similarity; what it drops is never more than brute force does
    assert same >= 0.98 * len(want) and all(len(got[i]) >= len(want[i]) for i in want)
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    docs = out

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = STAGES["MinHash near-dedup"](spark, docs, SF).cache()
    assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in brute_groups(rows, 80).items() if c == i}
    docs = out

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = STAGES["benchmark decontamination"](spark, docs, SF).cache()
    hit = {i: brute_hits(t, items) for i, t in rows}
    assert {r.doc_id for r in out.collect()} == {i for i, (n, h, _) in hit.items() if not (h > 0 and 20 * h >= n)}
    assert sorted(out.columns) == columns
    docs = out

    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    found = c.execute(queries.ORACLES["op4_mixing"]).fetchall()
    want = sorted((r[0], r[5]) for r in found if r[5])
    assert want and sorted((r.doc_id, r.n_copies) for r in STAGES["mixing to target weights"](spark, docs, SF).collect()) == want


ODD = "doc_id long, text string, lang string, source string, n_chars long, pos int, component string, mix_tokens string, _found string"
EDGES = [
    (1, None, "en", "src0", None), (2, "", "en", "src0", 0), (None, "the cat sat on the mat and then it was here", "en", None, 9),
    (3, "the first line of this text is here\nthe second one", None, "src1", 5), (3, "the first line of this text is here\nthe second one", None, "src1", 5),
    (4, "of the and to in is that it for was on are " * 20_000, "en", "src2", 1), (5, "² ½ 12 !?", "fr", "src3", 3), (6, "le la les des une est dans pour que qui sur avec", "fr", None, 2),
]


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_odd_rows(spark, name):
    """Nulls in every column, empty and very long texts, repeated rows, an empty table, and columns with clashing names."""
    docs = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in EDGES], ODD)
    got = sorted(((r.doc_id, r.text) for r in STAGES[name](spark, docs, SF).collect()), key=repr)
    ids = [i for i, _ in got]
    if name == "language ID":
        assert not {1, 2, 5} & set(ids) and ids.count(3) == 2 and None in ids
    elif name == "line dedup":
        assert {1, 2, 4, 5, 6, None} <= set(ids) and dict(got)[1] is None and dict(got)[2] == ""
        assert [t for i, t in got if i == 3] == [EDGES[3][1]] * 2
    elif name in ("MinHash near-dedup", "benchmark decontamination"):
        assert sorted(map(repr, ids)) == sorted(repr(r[0]) for r in EDGES)
    else:
        assert not {1, 2} & set(ids) and ids.count(3) in (0, 2)
    empty = STAGES[name](spark, docs.where("false"), SF)
    assert empty.count() == 0
    nulls = docs.select(*[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    assert STAGES[name](spark, nulls, SF).count() == (0 if name in ("language ID", "mixing to target weights") else len(EDGES))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    assert re.match(r"(file:)?/", common.shared_dir(spark))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    c = connection("/root/testdata/sf0.001")
    assert compare(spark, c, queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_line_stage_loses_no_variant(spark):
    """Of a large family of one line's variants, the line stage keeps what plain character shingles keep."""
    rng = random.Random(8)
    lines = [x for _ in range(2) for x in family(rng, 200)]
    docs = spark.createDataFrame([(i, x, "en", "web", len(x)) for i, x in enumerate(lines)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.line_deduplication(spark, docs, "").collect()}
    assert left == set(range(len(lines))) - brute_lines(lines)


def test_line_stage_compares_short_lines_of_wide_characters(spark):
    """Lines of fewer than eight characters, but of eight code units or more, have shingles and meet others."""
    lines = ["🙂" * 6, "🙂" * 7, "🙂" * 9, "🙂" * 3, "🙂" * 2, "🙃🙂" * 3, "short"]
    docs = spark.createDataFrame([(i, x, "en", "web", len(x)) for i, x in enumerate(lines)], "doc_id long, text string, lang string, source string, n_chars long")
    units = [x.encode("utf-16-be") for x in lines]
    sets = [{u[i : i + 16] for i in range(0, max(len(u) - 15, 1), 2)} for u in units]
    want = {b for b in range(len(lines)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want == {1, 2}
    left = {r.doc_id for r in corpus_pipeline.line_deduplication(spark, docs, "").collect()}
    assert left == set(range(len(lines))) - want
