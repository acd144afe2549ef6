"""URL filters: fixed rules, else the empirical-Bayes reputation of the host.

Labelled pages are counted by host; the counts climb to registered domain and
suffix. At each level the beta prior has its mean from the level above and its
strength from the spread of the level's own rates (method of moments), so a
host with few labels leans on its domain, a domain on its suffix, a suffix on
the whole; a host without any has the prior of the nearest level that has some
for its posterior. A host is blocked when the upper bound of its posterior good
rate lies under ``threshold``.

All of it is DataFrame expressions. Rows are counted before they are shuffled;
the join back to pages is an equi-join whose large partitions adaptive
execution splits, so a host with a third of all pages is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end; A-Z lowered; else empty."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, prefix = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


#: Labels under which registries of two-letter countries register names.
SECOND_LEVEL = "ac|co|com|edu|gov|net|org"
_SECOND = rf"\.((?:{SECOND_LEVEL})\.[a-z]{{2}})$"
_ADDRESS = r"^([0-9]{1,3}\.){3}[0-9]{1,3}$|^\["


def domain_of(host: Column) -> Column:
    """The registered domain of the host without its port: one label more than the suffix, an address as it is."""
    bare = _bare(host)
    labels = F.when(bare.rlike(_SECOND), F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    return F.when(bare.rlike(_ADDRESS), bare).otherwise(labels)


def suffix_of(host: Column) -> Column:
    """The last label, or two where the last but one is a registry's; none for an address."""
    bare = _bare(host)
    last = F.when(bare.rlike(_SECOND), F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    return F.when(bare.rlike(_ADDRESS), F.lit("")).otherwise(last)


def _bare(host: Column) -> Column:
    return F.regexp_replace(host, r":\d*$", "")


def _level(children: DataFrame, key: str) -> DataFrame:
    """Counts of ``children`` by ``key``, with the moments that the strength needs."""
    rate = F.col("good") / F.col("n")
    return children.groupBy(key).agg(
        F.sum("n").alias("n"),
        F.sum("good").alias("good"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * rate * rate).alias("nr2"),
    )


def _strength(low: float, high: float) -> Column:
    """Prior strength from the spread of children around their mean.

    Moments of the beta-binomial: s2 the weighted variance of child rates, less
    what binomial noise alone makes; clamped to [low, high].
    """
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    mean = F.col("good") / n
    spread = mean * (1 - mean)
    between = F.greatest(F.col("nr2") / n - mean * mean - spread * k / n, F.lit(0.0))
    return F.when((between > 0) & (spread > 0), F.least(F.greatest(spread / between - 1, F.lit(low)), F.lit(high))).otherwise(F.lit(high))


def reputations(hosts: DataFrame, outcomes: DataFrame, *, low: float = 2.0, high: float = 50.0) -> DataFrame:
    """(host, alpha, beta): the posterior of every row of ``hosts`` (host), null if there are no outcomes.

    ``outcomes``: (host, good) with good a non-null boolean.
    """
    own = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    placed = lambda df: df.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = _level(placed(own), "domain").withColumn("kappa", _strength(low, high)).withColumn("suffix", suffix_of(F.col("domain")))
    suffixes = _level(domains, "suffix").withColumn("kappa", _strength(low, high))
    whole = _level(suffixes.withColumn("all", F.lit(0)), "all").withColumn("kappa", _strength(low, high))
    mean = lambda above, strength: (F.col("good") + F.col(strength) * F.col(above)) / (F.col("n") + F.col(strength))
    top = F.broadcast(whole.select("all", (F.col("good") / F.col("n")).alias("mean0"), F.col("kappa").alias("kappa0")))
    suffixes = suffixes.withColumn("all", F.lit(0)).join(top, "all").select("suffix", mean("mean0", "kappa0").alias("mean1"), F.col("kappa").alias("kappa1"))
    domains = domains.join(suffixes, "suffix").select("domain", mean("mean1", "kappa1").alias("mean2"), F.col("kappa").alias("kappa2"))
    every = placed(hosts).withColumn("all", F.lit(0)).join(own, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left").join(top, "all", "left")
    prior, strength = F.coalesce("mean2", "mean1", "mean0"), F.coalesce("kappa2", "kappa1", "kappa0")
    good, bad = F.coalesce("good", F.lit(0)), F.coalesce(F.col("n") - F.col("good"), F.lit(0))
    return every.select("host", (good + strength * prior).alias("alpha"), (bad + strength * (1 - prior)).alias("beta"))


def upper_bound(alpha: Column, beta: Column, z: float) -> Column:
    """Upper credible bound of a beta posterior, by its mean and deviation."""
    s = alpha + beta
    return F.least(alpha / s + z * F.sqrt(alpha * beta / (s * s * (s + 1))), F.lit(1.0))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    *,
    rules=RULES,
    threshold: float = 0.5,
    z: float = 1.645,
    page_id: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
    label_col: str = "quality",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) for every row of ``pages``.

    ``outcomes`` labels pages by id: ``label_col`` 1 is good, 0 bad, null no
    label. A null url or one without ``://`` has empty host and path, fits no
    rule and is judged as the host ''. If there are no labels at all, bounds
    are null and what no rule blocks is allowed. Repeated rows each get a row; a
    page labelled twice counts twice; an empty table gives none. Urls may have
    any length, and other columns are not read.
    """
    urls = pages.select(F.col(page_id).alias("page_id"), F.col(url_col).alias("_url"))
    own = urls.select("page_id", F.coalesce(host_of(F.col("_url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("_url")), F.lit("")).alias("path"))
    labels = outcomes.select(F.col(label_id).alias("page_id"), (F.col(label_col) == 1).alias("good")).where("page_id is not null and good is not null")
    marked = own.select("page_id", "host").join(labels, "page_id").select("host", "good")
    known = reputations(own.select("host").distinct(), marked).select("host", upper_bound(F.col("alpha"), F.col("beta"), z).alias("bound"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bound") < threshold, F.lit("block")).otherwise(F.lit("allow"))
    return own.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "bound")
