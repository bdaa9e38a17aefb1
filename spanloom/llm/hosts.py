"""URL filters: path rules first, then an empirical-Bayes reputation of the host.

Labelled pages are counted per host, registered domain and suffix. The rate of bad pages is
shrunk level by level through beta-binomial priors: a suffix towards the overall rate, a domain
towards its suffix, a host towards its domain; the strength of each prior is estimated from the
spread of the groups of its level (method of moments). A host is blocked where a lower bound of
its posterior rate is above the threshold, so a host with few labels is blocked only on the
evidence of its domain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

# Suffixes of more than one label under which names are registered; others have one label.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "or.jp", "org.au", "org.uk")


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """Lower-case (A-Z) text between the first :// and the next /, ? or #; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null where none does. A rule fits its
    host and all subdomains where the path starts with its own; the first of equals wins."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)) if name is None else name.when(fits, F.lit(r.name))
        verdict = F.when(fits, F.lit(r.verdict)) if verdict is None else verdict.when(fits, F.lit(r.verdict))
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _suffix_and_domain(host: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(host, r"(^.*@)|(:[0-9]*$)|(\.$)", "")
    long = F.substring_index(bare, ".", -2).isin(*LONG_SUFFIXES)
    number = bare.rlike(r"^[0-9.]+$|^\[")
    suffix = F.when(number, bare).when(long, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(number, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    return suffix, domain


def _strength(groups: DataFrame, n: str, bad: str) -> tuple[float, float]:
    """Overall rate of one level and the strength of a beta prior that explains how far the
    rates of its groups lie apart; from four sums."""
    seen = groups.where(F.col(n) > 0)
    k, total, hits, squares = seen.agg(
        F.count(F.lit(1)), F.sum(n), F.sum(bad), F.sum(F.col(bad) * F.col(bad) / F.col(n))
    ).first()
    if not total:
        return 0.0, 2.0
    rate = hits / total
    noise = rate * (1 - rate)
    between = (squares / total - rate * rate - noise * k / total) / max(1e-9, 1 - k / total)
    if noise <= 0 or between <= 0:
        return rate, 1000.0
    return rate, round(min(1000.0, max(2.0, noise / between - 1)), 6)


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """One row per host of `pages` (page_id, host): host, n_labelled, n_bad, rate (posterior
    mean of bad pages) and bad_bound (its lower bound, z standard deviations below).

    outcomes: page_id, bad (boolean; null is no label). Several labels of a page count as one,
    bad if any is; labels of unknown pages are not used; without any label all rates are 0."""
    labels = outcomes.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull())
    labels = labels.groupBy(F.col("page_id").alias("__page")).agg(F.max("bad").alias("__bad"))
    seen = pages.join(labels, pages["page_id"] == F.col("__page"), "left")
    suffix, domain = _suffix_and_domain(F.col("host"))
    hosts = seen.groupBy("host").agg(
        F.count("__bad").alias("n_labelled"), F.coalesce(F.sum(F.col("__bad").cast("long")), F.lit(0)).alias("n_bad")
    )
    hosts = materialize(hosts.select("host", suffix.alias("__suffix"), domain.alias("__domain"), "n_labelled", "n_bad"), "hosts")
    domains = hosts.groupBy("__suffix", "__domain").agg(F.sum("n_labelled").alias("__nd"), F.sum("n_bad").alias("__bd"))
    suffixes = domains.groupBy("__suffix").agg(F.sum("__nd").alias("__ns"), F.sum("__bd").alias("__bs"))
    overall, k_suffix = _strength(suffixes, "__ns", "__bs")
    _, k_domain = _strength(domains, "__nd", "__bd")
    _, k_host = _strength(hosts, "n_labelled", "n_bad")

    shrunk = lambda bad, n, k, towards: (F.col(bad) + k * towards) / (F.col(n) + k)
    of_suffix = suffixes.select("__suffix", shrunk("__bs", "__ns", k_suffix, F.lit(overall)).alias("__ms"))
    of_domain = domains.join(of_suffix, "__suffix").select(
        "__suffix", "__domain", shrunk("__bd", "__nd", k_domain, F.col("__ms")).alias("__md")
    )
    out = hosts.join(of_domain, ["__suffix", "__domain"])
    a = F.col("n_bad") + k_host * F.col("__md")
    weight = F.col("n_labelled") + F.lit(k_host)
    rate = a / weight
    spread = F.sqrt(rate * (1 - rate) / (weight + 1))
    return out.select("host", "n_labelled", "n_bad", rate.alias("rate"), F.greatest(F.lit(0.0), rate - z * spread).alias("bad_bound"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[UrlRule], url: str = "url", threshold: float = 0.5, z: float = 1.645
) -> DataFrame:
    """All columns of `pages` and host, path, rule, verdict (allow or block), bad_bound.

    pages: page_id, a url column, any others; outcomes: page_id, bad. A null url or one without
    :// has an empty host and path, and is judged as the host named empty. Repeated rows come
    out alike; null page ids have no labels; an empty table gives an empty result. Columns of
    `pages` named like the new ones are replaced."""
    new = ("host", "path", "rule", "verdict", "bad_bound")
    rows = pages.withColumns({"host": url_host(F.col(f"`{url}`").cast("string")), "path": url_path(F.col(f"`{url}`").cast("string"))})
    known = host_reputation(rows.select("page_id", "host"), outcomes, z).select(F.col("host").alias("__host"), "bad_bound")
    rows = rows.drop("rule", "verdict", "bad_bound")
    out = rows.join(known, rows["host"] == known["__host"], "left")
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in new]
    return out.select(*kept, "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_bound")
