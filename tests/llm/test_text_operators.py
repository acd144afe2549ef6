"""Decontamination, URL filters, token counts, language ID, toxicity: brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as D
from tidemark.llm import langid as G
from tidemark.llm import token_count as T
from tidemark.llm import toxicity as X
from tidemark.llm import url_filter as U

DOCS = "doc_id long, text string, n_hit string, _found string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(text, items, window=13):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for name, item in items:
        own = WORD.findall((item or "").translate(LOWER))
        m = min(window, len(own))
        for a in range(len(own) - m + 1 if m else 0):
            for b in range(len(words) - m + 1):
                if words[b : b + m] == own[a : a + m]:
                    hit |= set(range(b, b + m))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "Éa", "c9", "d"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 13, 16, 30]))) for i in range(12)] + [(90, None), (91, ""), (92, "!?"), (3, "repeated id " * 8)]
    docs = [(i, text(rng.randint(0, 60)).replace(" ", rng.choice([" ", "-", "\n"])), "x", "y") for i in range(40)]
    docs += [(100, None, "x", "y"), (101, "", "x", "y"), (101, "", "x", "y"), (102, "x " + items[4][1].upper() + " y", None, None), (103, "w " * 50_000, None, None)]
    found = D.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    got = found.select("doc_id", "text", *[c.alias(f"r_{k}") for k, c in D.verdict().items()]).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, names = brute_hits(r.text if r.doc_id != 103 else "w " * 50_000, [] if r.doc_id == 103 else items)
        assert (r.r_n_words, r.r_n_hit, r.r_n_items) == (n, hit, len(names)), r.doc_id
        assert r.r_items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r.r_contaminated == (hit > 0 and 20 * hit >= n)


def test_decontamination_in_blocks_and_empty(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five six")], "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["one two", "three four", "six"])], "item_id long, text string")
    whole = D.find(docs, items).select("doc_id", *[c.alias(k) for k, c in D.verdict().items()])
    blocks = D.find(docs, items, block_bytes=1).select("doc_id", *[c.alias(k) for k, c in D.verdict().items()])
    assert sorted(whole.collect()) == sorted(blocks.collect())
    none = D.find(docs, items.where("false")).select("_found.n_words", *[c.alias(k) for k, c in D.verdict().items() if k != "n_words"]).collect()
    assert [r.n_hit for r in none] == [0, 0] and not any(r.contaminated for r in none)
    assert D.find(docs.where("false"), items).count() == 0
    assert [r.doc_id for r in D.drop_contaminated(docs, items.where("item_id < 2")).collect()] == [2]


def test_decontamination_of_common_pairs():
    """Thousands of windows that end alike are one bucket, and give what brute force gives; tables stay small."""
    rng = random.Random(8)
    item = " ".join(f"w{rng.randrange(3000)} of the" for _ in range(2000))
    names, numbers, matchers = D.build([("a", item.encode()), ("b", item[4000:9000].encode()), ("c", b"of the")], 13)
    assert max(hi - lo for lo, hi in matchers[0].buckets.values()) > 1500
    own = item.split()
    text = own[100:140] + ["x", "of", "the"] + own[1500:1512] + ["y"]
    spans, found = D.hits([w.encode() for w in text], names, numbers, matchers)
    n, hit, items = brute_hits(" ".join(text), [("a", " ".join(own[80:160])), ("b", item[4000:9000]), ("c", "of the")])
    assert sum(b - a for a, b in spans) == hit and found == set(items)


def test_urls(spark):
    rows = [
        (1, "http://A.net/x"), (2, "https://sub.example.net/en/1?q"), (3, "https://example.com/de/"), (4, "http://x.org/fr/a"), (5, "http://a.net"),
        (6, None), (7, "no scheme"), (8, "http://notexample.com/de/x"), (8, "http://notexample.com/de/x"), (9, "ftp://Ü.org:80/fr#x"), (10, "http://a.net?x=/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("clash")).withColumn("host", F.lit(1))
    labels = spark.createDataFrame([(8, 1), (3, 0), (99, 1), (None, 1), (4, None)], "doc_id long, quality int")
    got = {r.page_id: r for r in U.judge(pages, labels).collect()}
    assert len(got) == 10
    seen = {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()}
    assert seen[1] == ("a.net", "/x", "net/", "block")
    assert seen[2] == ("sub.example.net", "/en/1", "example.net/en/", "allow")
    assert seen[3] == ("example.com", "/de/", "example.com/de/", "block")
    assert seen[4] == ("x.org", "/fr/a", "org/fr/", "allow")
    assert seen[5][:3] == ("a.net", "", None) and seen[10][:3] == ("a.net", "", None)
    assert seen[6][:3] == ("", "", None) and seen[7][:3] == ("", "", None)
    assert seen[8][:3] == ("notexample.com", "/de/x", None)
    assert seen[9][:2] == ("Ü.org:80", "/fr")
    assert U.judge(pages, labels.where("false")).where("rule is null and verdict != 'allow'").count() == 0


def test_reputation_shrinks(spark):
    """A host of bad pages is blocked; one bad page on a good domain is not."""
    rows = [(i, "http://bad.example/x") for i in range(60)] + [(100 + i, f"http://h{i % 20}.good.test/") for i in range(200)] + [(999, "http://new.good.test/")]
    labels = [(i, int(i >= 60)) for i in range(300)] + [(999, 0)]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    verdicts = {(r.host, r.verdict) for r in got.collect()}
    assert ("bad.example", "block") in verdicts and ("new.good.test", "allow") in verdicts and ("h3.good.test", "allow") in verdicts


def test_hosts_without_labels(spark):
    """Such a host is judged by its domain, else its suffix, else the whole; registries' labels and addresses are no domains."""
    rows = [(i, f"http://h{i % 6}.bad.co.uk/") for i in range(120)] + [(200 + i, f"http://s{i % 9}.fine.co.uk/") for i in range(120)] + [(400 + i, f"http://10.1.2.{i % 4}:80/") for i in range(80)]
    rows += [(900, "http://new.bad.co.uk/"), (901, "http://new.fine.co.uk/"), (902, "http://other.co.uk/"), (903, "http://10.1.2.9/"), (904, None), (905, "http://[::1]:8080/x")]
    labels = [(i, 0) for i in range(120)] + [(200 + i, 1) for i in range(120)] + [(400 + i, i % 4 // 3) for i in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in U.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got[900].verdict == "block" and got[901].verdict == "allow" and got[902].verdict == "allow"
    assert got[400].verdict == "block" and got[403].verdict == "allow" and all(got[i].bound is not None for i in (903, 904, 905))
    assert U.judge(pages.where("false"), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0
    hosts = spark.createDataFrame([("a.b.co.uk:80",), ("co.uk",), ("x.com",), ("1.2.3.4",), ("[::1]",), ("",)], "h string")
    assert [tuple(r) for r in hosts.select(U.domain_of(F.col("h")), U.suffix_of(F.col("h"))).collect()] == [("b.co.uk", "co.uk"), ("co.uk", "uk"), ("x.com", "com"), ("1.2.3.4", ""), ("[::1]", ""), ("", "")]


def brute_pieces(word, vocabulary):
    n = i = 0
    while i < len(word):
        k = next((k for k in range(len(word) - i, 0, -1) if word[i : i + k] in vocabulary), 1)
        i, n = i + k, n + 1
    return n


def test_token_counts_match_greedy_search(spark, tmp_path):
    import base64

    rng = random.Random(1)
    vocabulary = {bytes([b]) for b in range(256)} | {bytes(rng.choice(b" abc") for _ in range(rng.randint(2, 6))) for _ in range(80)}
    path = tmp_path / "v.tiktoken"
    path.write_text("".join(f"{base64.b64encode(w).decode()} {i}\n" for i, w in enumerate(sorted(vocabulary))))
    texts = ["".join(rng.choice("abc é\n") for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None, "", "  ", "ab" * 40_000]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "a", 1)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in T.count_tokens(docs, vocabulary=str(path)).collect()}
    for i, t in enumerate(texts[:-1]):
        words = (t or "").encode().split()
        assert got[i] == (len(words), sum(brute_pieces(b" " + w, vocabulary) for w in words))
    assert got[len(texts) - 1][0] == 1 and None in got


def test_token_counts_of_repeats_and_nothing(spark):
    docs = spark.createDataFrame([("a", "one two", 1), ("a", "one two", 1), ("b", None, None)], "doc_id string, text string, n_words int")
    got = sorted((r.doc_id, r.n_words) for r in T.count_tokens(docs).collect())
    assert got == [("a", 2), ("a", 2), ("b", 0)]
    assert T.count_tokens(docs.where("false")).count() == 0


def test_token_automaton_without_single_bytes():
    rng = random.Random(2)
    for _ in range(2000):
        vocabulary = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 8))}
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
        assert T.Automaton(vocabulary).count(word) == brute_pieces(word, vocabulary)


def test_gru_gradients():
    net = G.Network.fresh(["a", "b"], 3, 1)
    for d in (net.ahead, net.back):
        for k in ("w", "u", "c"):
            setattr(d, k, getattr(d, k).astype(np.float64))
    rng = np.random.default_rng(0)
    x, y, n = rng.integers(0, 9, (4, 5)).astype(np.uint8), np.array([0, 1, 1, 0]), np.array([5, 5, 3, 1])

    def loss():
        live = (np.arange(5)[:, None] < n).astype(np.float32)
        p, _ = net.positions(np.ascontiguousarray(x.T), live)
        return -(np.log(p[:, y, np.arange(4)]) * live).sum() / live.sum()

    grads = net.step(x, y, n)
    for name, at in (("ahead.w", (1, 3)), ("ahead.u", (4, 1)), ("back.u", (8, 2)), ("back.c", (1, 0)), ("v", (1, 4)), ("b", (0, 0))):
        p = net.parameters()[name]
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-3), name


def test_language_windows_hold_every_byte_once():
    """Each segment is judged with what stands on either side of it, and nothing of another text."""
    rng = random.Random(4)
    texts = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in (1, 31, 64, 65, 200, 64 * 70)]
    seen = {i: b"" for i in range(len(texts))}
    for x, before, lengths, after, owner in G.windows(texts):
        for row, b, n, a, i in zip(x, before, lengths, after, owner):
            at = len(seen[i])
            assert bytes(row[G.CONTEXT - b : G.CONTEXT + n]) == texts[i][at - b : at + n] and b == min(at, G.CONTEXT)
            assert bytes(row[G.CONTEXT + G.SEGMENT : G.CONTEXT + G.SEGMENT + a]) == texts[i][at + G.SEGMENT : at + G.SEGMENT + a]
            assert a == min(max(len(texts[i]) - at - G.SEGMENT, 0), G.CONTEXT)
            seen[i] += bytes(row[G.CONTEXT : G.CONTEXT + n])
    assert [seen[i] for i in range(len(texts))] == texts


def test_language_states_cross_segments():
    """With the context, positions after a border differ little from those of one long walk; without it, they start from nothing."""
    net = G.Network.fresh(["a", "b", "c"], 6, 3)
    text = bytes(random.Random(6).choice(b"abcdefgh ") for _ in range(1000))
    x = np.frombuffer(text, np.uint8)[:, None]
    whole = net.positions(x, None)[0][:, :, 0].sum(axis=0) / len(text)
    carried = sum(net.pooled(*w[:4]).sum(axis=0) for w in G.windows([text])) / len(text)
    cut = sum(net.positions(x[i : i + G.SEGMENT], None)[0][:, :, 0].sum(axis=0) for i in range(0, len(text), G.SEGMENT)) / len(text)
    assert np.abs(carried - whole).max() < 1e-4 < np.abs(cut - whole).max()


def test_language_id_learns_every_label(spark):
    """Rare labels are learned too, marks that are no letters make no language, repeated rows agree."""
    rows = [(i, f"{chr(0x4E00 + k)}{chr(0x4E01 + k)} " * 60, f"l{k:02d}") for k in range(0, 140, 2) for i in (10 * k, 10 * k + 1, 10 * k + 3)]
    docs = spark.createDataFrame(rows + rows[:2] + [(-1, "² ½ ¼ 12", None), (-2, "ªº", None)], "doc_id long, text string, lang string")
    texts, names = G.sample(docs, id_col="doc_id", text_col="text", lang_col="lang", held_mod=4, held_rem=2)
    assert len(set(names)) > 64 and all(len(t) == 420 for t in texts)
    got = G.identify(docs, steps=2).collect()
    assert len(got) == len(rows) + 4 and {r.lang_pred for r in got if r.doc_id == -1} == {"und"} and "und" not in {r.lang_pred for r in got if r.doc_id != -1}
    assert len({(r.lang_pred, r.lang_score) for r in got if r.doc_id == 0}) == 1


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "123 !?", None), (-4, "é" * 200_000, None), (None, "the of and", None)], docs.schema)
    out = G.identify(docs.union(odd).withColumn("lang_pred", F.lit("clash")))
    rows = out.collect()
    assert len(rows) == docs.count() + 5
    held = [r for r in rows if r.doc_id is not None and r.doc_id >= 0 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].lang_score == 0 for i in (-1, -2, -3)) and by[-4].lang_pred in ("fr", "es", "en", "de")
    assert all(0 <= r.lang_score <= 1 for r in rows)
    none = G.identify(docs.limit(3).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert G.identify(docs.where("false")).count() == 0


def test_grammar():
    lexicon, table = X.Lexicon({"idiot$": 2.0, "lowei": 1.0}), X.grammar()
    score = lambda t: sum(X.clauses(t, lexicon, table))
    assert score("a plain text.") == 0 and score(None) == 0 and score("") == 0
    assert score("idiot") == pytest.approx(2.0) and score("loweitum x") == pytest.approx(1.0)
    assert score("you are an idiot") == pytest.approx(3.0)
    assert score("not an idiot") == pytest.approx(0.8)
    assert score("not a b c idiot") == pytest.approx(2.0)
    assert score("she said idiot") == pytest.approx(2.0 * 1.5 * 0.6)
    assert score("not x. idiot") == pytest.approx(2.0)
    assert len(X.clauses("idiot. ok. idiot", lexicon, table)) == 2
    assert score("idiot you") == score("you idiot") == score("you idiot you") == pytest.approx(3.0)
    assert score("idiot.\nyou") == pytest.approx(2.0)
    # a threat verb counts unlearned, but only at a target that follows closely
    assert score("i will kill you") == pytest.approx(2.0) and score("kill the old process") == 0 and score("you kill") == 0
    assert score("kill a b c you") == pytest.approx(2.0) and score("kill a b c d you") == 0
    assert score("i would never kill you") == pytest.approx(0.8) and score("she said kill them") == pytest.approx(1.2)
    learned = X.Lexicon({"kill$": 3.0})
    assert sum(X.clauses("kill time", learned, table)) == pytest.approx(3.0) and sum(X.clauses("kill them", learned, table)) == pytest.approx(6.0)


def test_composed_grammar_is_the_cascade():
    """The table scores random clauses as the transducers do one after the other, and as the rules say in words."""
    rng = random.Random(5)
    table, steps = X.grammar(), [make() for make in X.FORWARD]
    for _ in range(3000):
        clause = [rng.choice([X.OTHER, X.OTHER, X.INSULT, X.THREAT, X.TARGET, X.NEGATION, X.REPORT]) for _ in range(rng.randint(0, 12))]
        weights = [rng.choice([0.0, 0.7, 2.0]) if s in (X.INSULT, X.THREAT) else 0.0 for s in clause]
        marks, state, marked = X.aim(), 0, []
        for s in reversed(clause):
            state, out, _ = marks.step(state, s)
            marked.insert(0, out)
        line, factor = marked, [0.0] * len(clause)
        for t in steps:
            state, after = 0, []
            for i, s in enumerate(line):
                state, out, w = t.step(state, s)
                after.append(out)
                factor[i] += w
            line = after
        cascade = sum((max(w, X.THREAT_WEIGHT) if o == X.AIMED_THREAT else w) * math.exp(f) for o, w, f in zip(line, weights, factor) if o in X.MATCHES)
        plain = 0.0
        for i, s in enumerate(clause):
            if s not in (X.INSULT, X.THREAT):
                continue
            w = weights[i]
            if s == X.INSULT and X.TARGET in clause[:i] + clause[i + 1 :]:
                w *= 1.5
            if s == X.THREAT and X.TARGET in clause[i + 1 : i + 5]:
                w = 2 * max(w, X.THREAT_WEIGHT)
            if X.NEGATION in clause[max(0, i - 3) : i]:
                w *= 0.4
            if X.REPORT in clause[:i]:
                w *= 0.6
            plain += w
        assert table.score(clause, weights) == pytest.approx(cascade) == pytest.approx(plain)


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("clash"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = docs.select("doc_id", "text", "score").union(spark.createDataFrame([(-1, None, ""), (-2, "", ""), (-3, "x" * 300_000, "")], "doc_id long, text string, score string"))
    rows = X.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.9
    assert {r.score for r in X.score(docs.limit(3), labels.where("false")).collect()} == {0.0}


def test_toxicity_of_few_rows(spark):
    """Too few labels to calibrate on make no text toxic by themselves; repeated rows and empty tables are defined."""
    docs = spark.createDataFrame([(1, "a fine day"), (1, "a fine day"), (2, "we will kill you all"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    got = X.score(docs, labels).collect()
    assert sorted((str(r.doc_id), r.score >= 0.5) for r in got) == [("1", False), ("1", False), ("2", True), ("None", False)]
    assert X.score(docs.where("false"), labels).count() == 0
