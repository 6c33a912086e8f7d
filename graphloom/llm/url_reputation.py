"""URL filter: allow and block rules, then empirical-Bayes host reputation. DataFrame functions only.

Reputation: labelled page outcomes are counted by host, registered domain and public suffix. Each level is a
beta-binomial whose prior mean is the level above's posterior mean (suffix: the global rate, itself shrunk to the mean of
``PRIOR``) and whose strength is the level's own method-of-moments estimate. A host is blocked when the lower bound of its
posterior bad rate, ``mean - z * sd``, is above ``max_bad``.

The registered domain and suffix are taken of the host without user, port and last dots; an IP address is its own domain
and its own suffix, as unrelated machines share digits.

Defined results: a null url or one without ``://`` has empty host and path, no rule, and the reputation of the empty
host like any other. Hosts without labels take their domain's (suffix's, global) prior. Repeated pages count as often
as they occur; repeated labels of a page count once, the worst. Null outcomes are no labels. Without any label, or with one
bad label only, pages outside the rules are allowed. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch

#: Rules become one CASE expression; a larger list is refused rather than compiled into an endless one.
MAX_RULES = 500

#: Public suffixes of two labels that are told apart from the last label alone.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")

#: Labelled outcomes, bad and good, that every corpus begins with at the root.
PRIOR = (1, 9)

IPV4 = "^[0-9]{1,3}([.][0-9]{1,3}){3}$"
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``target`` is ``host/path...``; it fits the host and its subdomains where the path starts with the rule's."""

    target: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        own, _, rest = self.target.partition("/")
        return ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _HOST, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule's ``target``; null if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.target), r.target)):
        out = F.when(rule.fits(host, path), F.lit(rule.target)).otherwise(out)
    return out


def site_of(host: Column) -> Column:
    """The host without user, port and last dots."""
    for piece in ("^.*@", ":[0-9]*$", "[.]+$"):
        host = F.regexp_replace(host, piece, "")
    return host


def _is_address(site: Column) -> Column:
    return site.rlike(IPV4) | site.startswith("[")


def suffix_of(site: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(site, ".", -2)
    return F.when(_is_address(site), site).when(two.isin(*two_label), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(site, ".", -2)
    return F.when(_is_address(site), site).when(two.isin(*two_label), F.substring_index(site, ".", -3)).otherwise(two)


def _strength(level: DataFrame) -> DataFrame:
    """One row: the prior strength at a level of units ``(n, bad)`` by moments about the pooled rate.

    All sums are over whole numbers but one quotient, so that their order hardly matters.
    """
    n, x = F.col("n").cast("double"), F.col("bad").cast("double")
    sums = level.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("nn"), F.sum("bad").alias("xx"), F.sum(n * n).alias("n2"), F.sum(x * x / n).alias("x2"))
    m = F.col("xx") / F.col("nn")
    within = m * (1 - m)
    spread = F.col("x2") - m * F.col("xx")
    rho = (spread - within * (F.col("k") - 1)) / (within * (F.col("nn") - F.col("n2") / F.col("nn") - (F.col("k") - 1)))
    safe = F.when((F.coalesce(F.col("nn"), F.lit(0)) == 0) | (within == 0) | (F.col("k") < 2), None).otherwise(rho)
    clipped = F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.coalesce(F.nanvl(safe, F.lit(0.001)), F.lit(0.001))))
    return sums.select(1 / clipped - 1)


def _posterior(mean: Column, strength: Column, n: Column, bad: Column) -> Column:
    return (strength * mean + bad) / (strength + n)


def reputation(hosts: DataFrame, z: float = 1.645, max_bad: float = 0.25, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES, prior: tuple[float, float] = PRIOR) -> DataFrame:
    """``hosts(host, n, bad)``, one row a host -> ``(host, posterior, lower, blocked)``. ``two_label``: public suffixes of two labels."""
    named = hosts.withColumn("site", site_of(F.col("host")))
    named = named.withColumns({"domain": domain_of(F.col("site"), two_label), "suffix": suffix_of(F.col("site"), two_label)})
    total = lambda *keys: named.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains, suffixes, everything = total("domain", "suffix"), total("suffix"), total()
    # Single numbers over all rows, as scalar subqueries.
    rate = everything.select((F.coalesce("bad", F.lit(0)) + float(prior[0])) / (F.coalesce("n", F.lit(0)) + float(sum(prior)))).scalar()
    ks, kd, kh = (_strength(level).scalar() for level in (suffixes, domains, named))
    s = suffixes.select("suffix", _posterior(rate, ks, F.col("n"), F.col("bad")).alias("ps"))
    d = domains.join(s, "suffix").select("domain", _posterior(F.col("ps"), kd, F.col("n"), F.col("bad")).alias("pd"))
    h = named.join(d, "domain").withColumn("kh", kh)
    mean = _posterior(F.col("pd"), F.col("kh"), F.col("n"), F.col("bad"))
    lower = mean - z * F.sqrt(mean * (1 - mean) / (F.col("kh") + F.col("n") + 1))
    return h.select("host", mean.alias("posterior"), lower.alias("lower")).withColumn("blocked", F.col("lower") > max_bad)


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], z: float = 1.645, max_bad: float = 0.25) -> DataFrame:
    """``pages(page_id, url)`` and ``outcomes(page_id, bad 0/1)`` -> ``page_id, host, path, rule, verdict, posterior, lower``."""
    scratch = Scratch(pages.sparkSession, "url")
    seen = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    worst = outcomes.where("bad IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("bigint")).alias("bad"))
    counted = seen.select("page_id", "host").join(worst, "page_id", "left")
    hosts = counted.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    # The written table has a known size: small ones are broadcast by the planner, large ones shuffled with skew splits.
    table = scratch.table(reputation(scratch.table(hosts, "hosts"), z, max_bad), "reputation")
    judged = seen.join(table, "host", "left").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("blocked"), "block").otherwise("allow")
    for target, own in {r.target: r.verdict for r in rules}.items():
        verdict = F.when(F.col("rule") == target, F.lit(own)).otherwise(verdict)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "posterior", "lower")
