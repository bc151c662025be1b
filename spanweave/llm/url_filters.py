"""URL filters: allow and block rules, then an empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host and shrunk level by level:
suffix towards the whole corpus, registered domain towards its suffix, host towards its
domain. Each level's prior is a beta distribution whose mean is the parent's posterior mean
and whose strength is a moment estimate over that level's groups. A url that no rule
decides is blocked when the lower posterior bound of its host's bad rate is over a limit.

Edge cases: a null url, or one without ``://``, has an empty host and path and is judged as
host ``""``. Null ids are judged like others. Repeated rows are judged one by one. Outcomes
with a null id or a null flag are ignored; several outcomes of one id count once, as bad if
any is. Without outcomes every bound is 0, so all is allowed. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (verdict, host, path); the longest that fits wins, the first of equal length.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MAX_BAD = 0.25
Z = 1.645
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels; fixed here, since no list of public suffixes is at hand."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _fitting(host: Column, path: Column, rules) -> tuple[Column, Column]:
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, key: str) -> DataFrame:
    """One row: the moment estimate of the prior's strength over the groups of a level."""
    p, n = F.col("bad") / F.col("n"), F.col("n")
    mu = F.try_divide(F.sum("bad"), F.sum("n"))
    spread = F.try_divide(F.sum(n * p * p), F.sum("n")) - mu * mu
    noise = F.try_divide(mu * (1 - mu) * F.count(F.lit(1)), F.sum("n"))
    raw = (mu * (1 - mu) - spread) / F.greatest(spread - noise, F.lit(1e-9))
    return groups.agg(F.coalesce(F.least(F.greatest(raw, F.lit(1.0)), F.lit(1000.0)), F.lit(1.0)).alias(key))


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """host, n, bad, rate, bound: the posterior mean and lower bound of each host's bad rate.

    pages: page_id, url. outcomes: page_id, bad (boolean). Only groups of hosts cross the
    network besides the labelled ids; their rows are counts made before the shuffle."""
    flags = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host")).join(flags, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rows = lambda df: df.where("n > 0")
    priors = _strength(rows(hosts), "m_host").crossJoin(_strength(rows(domains), "m_domain")).crossJoin(_strength(rows(suffixes), "m_suffix"))
    priors = priors.crossJoin(suffixes.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.0)).alias("mu")))
    shrunk = lambda mu, m: (F.col("bad") + F.col(m) * F.col(mu)) / (F.col("n") + F.col(m))
    p = F.broadcast(priors)  # one row
    suffixes = suffixes.crossJoin(p).select("suffix", shrunk("mu", "m_suffix").alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").crossJoin(p).select("domain", shrunk("suffix_rate", "m_domain").alias("domain_rate"))
    hosts = hosts.join(domains, "domain").crossJoin(p)
    hosts = hosts.withColumn("rate", shrunk("domain_rate", "m_host"))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("m_host") + 1))
    return hosts.select("host", "n", "bad", "rate", F.greatest(F.col("rate") - z * sd, F.lit(0.0)).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict and the bound behind a verdict without a rule."""
    pages = pages.select("page_id", "url")
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = _fitting(F.col("host"), F.col("path"), rules)
    bound = reputation(pages, outcomes, z).select("host", "bound")
    own = F.when(F.col("bound") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(bound, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound")
