"""Registered queries of the data-preparation operators, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, line_dedup, minhash, mixing, nn_descent, token_count, toxicity, url_filter, warc
from .common import crc_mod, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *[c.alias(k) for k, c in decontaminate.verdict().items()])


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, levels=mixing.LEVELS, weights=mixing.WEIGHTS, share=0.5, max_epochs=2, seed=1)
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("n_copies"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = langid.identify(table(spark, sf_dir, "documents"), columns=["doc_id", "text"])
    return judged.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.summary(spark, warc.archive(table(spark, sf_dir, "pages")))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.search(table(spark, sf_dir, "embeddings"), every=50, top=5)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "lines_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_url_filter,
        op3_token_counts,
        op4_mixing,
        op5_language_id,
        op6_warc,
        op7_nn_descent,
        op8_minhash,
        op9_line_dedup,
        op10_toxicity,
    )
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BENCH_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '')"
_LEVELS = ("domain", "lang", "source")


def _fill() -> str:
    """The budget tree of op4, a level a time."""
    weights = {level: "CASE " + " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in mixing.WEIGHTS[level].items()) + " ELSE 1 END" for level in _LEVELS}
    out, above = "", ""
    for i, level in enumerate(_LEVELS):
        here = ", ".join(_LEVELS[: i + 1])
        budget = f"(SELECT grant_ FROM g{i - 1} u WHERE " + " AND ".join(f"u.{x} = l.{x}" for x in _LEVELS[:i]) + ")" if i else "(SELECT CAST(floor(sum(tokens) * 0.5) AS BIGINT) FROM leaf)"
        part = f"PARTITION BY {above}" if above else ""
        out += f""",
n{i} AS (SELECT {here}, CAST(sum(cap) AS BIGINT) AS c, {weights[level]} AS w FROM leaf GROUP BY ALL),
m{i} AS (SELECT *, {budget} AS b, c / w AS ratio FROM n{i} l),
f{i} AS (SELECT *, coalesce(sum(c) OVER ({part} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + ratio * sum(w) OVER ({part} ORDER BY ratio, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= b AS full_ FROM m{i}),
g{i} AS (SELECT {here}, CASE WHEN full_ THEN c ELSE least(CAST(floor(CAST(b - sum(CASE WHEN full_ THEN c ELSE 0 END) OVER ({part}) AS DOUBLE) * w / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({part})) AS BIGINT), c) END AS grant_ FROM f{i})"""
        above = here
    return out


_DOMAIN = mixing.LEVELS["domain"]
_BELOW = "greatest(nr2 / n - (good / n) * (good / n) - (good / n) * (1 - good / n) * k / n, 0)"
_KAPPA = f"CASE WHEN {_BELOW} > 0 AND (good / n) * (1 - good / n) > 0 THEN least(greatest((good / n) * (1 - good / n) / {_BELOW} - 1, 2), 50) ELSE 50 END"


_BARE = "regexp_replace({h}, ':[0-9]*$', '')"
_SECOND = f"regexp_extract({_BARE}, '{url_filter._SECOND.replace('(?:', '(')}', 1) <> ''"
_ADDRESS = f"regexp_matches({_BARE}, '{url_filter._ADDRESS}')"
_PART = f"array_to_string(string_split({_BARE}, '.')[-{{n}}:], '.')"


def _domain(h: str) -> str:
    b = lambda x, **more: x.replace("{h}", h).replace("{n}", str(more.get("n")))
    return f"CASE WHEN {b(_ADDRESS)} THEN {b(_BARE)} WHEN {b(_SECOND)} THEN {b(_PART, n=3)} ELSE {b(_PART, n=2)} END"


def _suffix(h: str) -> str:
    b = lambda x, **more: x.replace("{h}", h).replace("{n}", str(more.get("n")))
    return f"CASE WHEN {b(_ADDRESS)} THEN '' WHEN {b(_SECOND)} THEN {b(_PART, n=2)} ELSE {b(_PART, n=1)} END"


def _rules() -> tuple[str, str]:
    rule, verdict = "NULL", "NULL"
    for what, text in sorted(url_filter.RULES, key=lambda r: (len(r[1]), r[1])):
        at, _, prefix = text.partition("/")
        fits = f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{prefix}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    return rule, verdict


ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCH_WORDS} AS w FROM benchmark),
bm AS (SELECT *, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM bm)),
dp AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS x FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bm) WHERE len(w) >= m)),
h AS (SELECT doc_id, i, m, item FROM dp JOIN win USING (m, x)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op2_url_filter": f"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
marked AS (SELECT host, quality = 1 AS good FROM p JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL),
h AS (SELECT host, {_domain("host")} AS domain, {_suffix("host")} AS suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(good AS INT)) AS DOUBLE) AS good FROM marked GROUP BY 1),
dm AS (SELECT domain, {_suffix("domain")} AS suffix, sum(n) AS n, sum(good) AS good, count(*) AS k, sum(n * (good / n) * (good / n)) AS nr2 FROM h GROUP BY 1),
dk AS (SELECT *, {_KAPPA} AS kappa FROM dm),
sm AS (SELECT suffix, sum(n) AS n, sum(good) AS good, count(*) AS k, sum(n * (good / n) * (good / n)) AS nr2 FROM dk GROUP BY 1),
sk AS (SELECT *, {_KAPPA} AS kappa FROM sm),
am AS (SELECT sum(n) AS n, sum(good) AS good, count(*) AS k, sum(n * (good / n) * (good / n)) AS nr2 FROM sk),
ak AS (SELECT good / n AS mean0, {_KAPPA} AS kappa0 FROM am),
s1 AS (SELECT suffix, (good + kappa0 * mean0) / (n + kappa0) AS mean1, kappa AS kappa1 FROM sk, ak),
d1 AS (SELECT domain, (good + kappa1 * mean1) / (n + kappa1) AS mean2, kappa AS kappa2 FROM dk JOIN s1 USING (suffix)),
al AS (SELECT host, {_domain("host")} AS domain, {_suffix("host")} AS suffix FROM (SELECT DISTINCT host FROM p)),
pr AS (SELECT al.host, coalesce(h.good, 0) AS g, coalesce(h.n - h.good, 0) AS f, coalesce(mean2, mean1, mean0) AS m, coalesce(kappa2, kappa1, kappa0) AS c FROM al LEFT JOIN h USING (host) LEFT JOIN d1 ON d1.domain = al.domain LEFT JOIN s1 ON s1.suffix = al.suffix, ak),
post AS (SELECT host, g + c * m AS a, f + c * (1 - m) AS b FROM pr),
bound AS (SELECT host, least(a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 1.0) AS bound FROM post)
SELECT page_id, host, path, {_rules()[0]} AS rule, coalesce({_rules()[1]}, CASE WHEN bound < 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN bound USING (host)""",
    "op4_mixing": f"""
WITH d AS (SELECT doc_id, {_DOMAIN} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(coalesce((length(text) + 3) // 4, 0) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 2 AS BIGINT) AS cap FROM d WHERE n_tokens > 0 GROUP BY ALL){_fill()},
e AS (SELECT domain, lang, source, grant_ // tokens AS epochs, grant_ % tokens AS rest FROM g2 JOIN leaf USING (domain, lang, source)),
o AS (SELECT d.*, epochs, rest, md5('1:' || epochs || ':' || doc_id) AS at_ FROM d LEFT JOIN e USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY at_) AS upto FROM o)
SELECT doc_id, domain, lang, source, n_tokens, CAST(CASE WHEN n_tokens > 0 THEN epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS n_copies FROM c""",
    "op6_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM p JOIN f USING (payload_digest)""",
    "op8_minhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(w)] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(w[i : i + 4]))) END AS x FROM d),
e AS (SELECT doc_id, len(x) AS n, list_sort(x) AS x FROM s),
k AS (SELECT x, min(doc_id) AS rep, any_value(n) AS n FROM e WHERE n > 0 GROUP BY 1),
v AS (SELECT rep, n, unnest(x) AS g FROM k),
pairs AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_ FROM v a JOIN v b ON a.g = b.g AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM pairs WHERE 100 * both_ >= 85 * (na + nb - both_)),
r(a, b) AS (SELECT rep, rep FROM k UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS rep, min(b) AS component FROM r GROUP BY 1)
SELECT e.doc_id, e.n AS n_shingles, coalesce(c.component, e.doc_id) AS component_id, coalesce(c.component, e.doc_id) = e.doc_id AS kept FROM e LEFT JOIN k ON e.n > 0 AND k.x = e.x LEFT JOIN c ON c.rep = k.rep""",
}
