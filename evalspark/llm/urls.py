"""Empirical-Bayes host reputation: labelled page outcomes shrunk through beta-binomial priors.

A host's bad-page rate has a beta prior around the posterior rate of its registered domain, the domain one
around its suffix, the suffix one around the global rate. The strength of each prior comes from the data
(moment estimate of the over-dispersion of the children around their parents). A host is blocked when the
lower posterior bound of its rate lies above ``max_bad``.

Edge cases. A url that is null or has no ``://`` has an empty host and path and is judged like a host of its
own. Hosts without labelled pages get their domain's posterior. With no labels at all the prior rate is 0.5 with
the widest spread allowed, which blocks nothing. Repeated pages and repeated labels: labels are folded per
document (bad if any row says so), pages count as often as they occur. Columns besides those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

RHO_MIN, RHO_MAX = 1e-4, 0.9  # range of the over-dispersion; a prior is worth 1/rho - 1 pages


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def document_outcomes(labels: DataFrame) -> DataFrame:
    """One row per labelled document: bad (0/1) if a label says toxic or low quality."""
    bad = F.greatest(F.coalesce(F.col("toxic"), F.lit(0)), 1 - F.coalesce(F.col("quality"), F.lit(1)))
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(bad).cast("long").alias("bad"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of every page; bad is null where the document that the url names has no label."""
    number = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*/[^/?#]+/([0-9]{1,18})", 1)
    named = pages.select(
        host_of(F.col("url")).alias("host"), F.when(number != "", number.cast("long")).alias("doc_id"))
    return named.join(document_outcomes(labels), "doc_id", "left").select("host", "bad")


def _shrunk(children: DataFrame) -> DataFrame:
    """children: n, bad, prior -> posterior parameters a and b under a prior of estimated strength."""
    p = F.least(F.greatest(F.col("prior"), F.lit(1e-6)), F.lit(1 - 1e-6))
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    excess = F.sum((bad - n * p) * (bad - n * p) / (p * (1 - p)) - n)
    pairs = F.sum(n * (n - 1))
    rho = children.agg(F.when(pairs > 0, excess / pairs).alias("rho"))
    bounded = rho.select(F.least(F.greatest(F.coalesce("rho", F.lit(RHO_MAX)), F.lit(RHO_MIN)), F.lit(RHO_MAX)).alias("rho"))
    weight = 1 / bounded.scalar() - 1
    return children.withColumn("weight", weight).select(
        *children.columns, (F.col("weight") * p + bad).alias("a"), (F.col("weight") * (1 - p) + n - bad).alias("b"))


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """outcomes (host, bad) -> one row per host: n labelled pages, bad ones, posterior mean, lower and upper bound.

    ``z`` standard deviations of the beta posterior give the bounds. Tables shrink level by level: one row per
    host, then per domain, then per suffix; pages are folded in the map tasks, so a hot host costs nothing.
    """
    hosts = stored(
        outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg((F.when(F.sum("n") > 0, F.sum("bad") / F.sum("n"))).alias("rate"))
    prior = total.select(F.coalesce("rate", F.lit(0.5)).alias("rate")).scalar()
    mean = F.col("a") / (F.col("a") + F.col("b"))
    suffixes = _shrunk(suffixes.withColumn("prior", prior)).select("suffix", mean.alias("prior"))
    domains = _shrunk(domains.join(suffixes, "suffix")).select("domain", mean.alias("prior"))
    shrunk = _shrunk(hosts.join(domains, "domain"))
    size = F.col("a") + F.col("b")
    spread = z * F.sqrt(F.col("a") * F.col("b") / (size * size * (size + 1)))
    return shrunk.select(
        "host", "n", "bad", mean.alias("mean"), F.greatest(mean - spread, F.lit(0.0)).alias("low"),
        F.least(mean + spread, F.lit(1.0)).alias("high"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, "host/path") that fits, and its verdict; both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, pattern in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = pattern.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, pattern).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judge_urls(
    pages: DataFrame, reputation: DataFrame, rules: list[tuple[str, str]] = (), max_bad: float = 0.3
) -> DataFrame:
    """page_id, host, path, rule, verdict: a fitting rule decides, else the lower bound of the host's bad rate."""
    host, path = F.col("host"), F.col("path")
    known = stored(reputation.select("host", (F.col("low") > max_bad).alias("bad_host")), "reputation")
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(host, path, list(rules))
    own = F.when(F.coalesce("bad_host", F.lit(False)), "block").otherwise("allow")
    return parts.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
