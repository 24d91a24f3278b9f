"""URL filters: fixed rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) are counted by host.  Good rates shrink towards their parent's:
host to registered domain to suffix to all pages, each level by a beta-binomial prior whose mean is the
parent's posterior mean and whose strength comes from the spread of the level's own rates (method of
moments).  A page is blocked where even the upper end of its host's posterior interval is below a bound.

Only built-in functions.  Pages are aggregated by host before anything is joined, so a host with a third
of all pages is one row per task; the join back is an equi-join with one row per host, whose skewed side
adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")

Z = 2.0  # width of the posterior interval in standard deviations
MIN_GOOD = 0.35  # a host is blocked if its rate is below this even at the upper end
STRENGTH = (2.0, 200.0)  # bounds of a prior's strength, in pages

Rule = tuple[str, str, str]  # host, start of the path, verdict


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path).  Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    path: from there up to ``?``, ``#`` or the end.  Null, or without ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits; rules are a short, given list.

    A rule fits its host and all subdomains if the path starts with the rule's.  Among equally long
    ones the alphabetically first wins."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def suffix_and_domain(host: Column, two_label_suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host; a host of fewer labels stands for itself.  A suffix is the last label, or
    the last two where they are among ``two_label_suffixes``."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    is_two = two.isin(*two_label_suffixes)
    last = F.element_at(labels, -1)
    three = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3))
    return F.when(is_two, two).otherwise(last), F.when(is_two, three).otherwise(two)


def _moments(level: DataFrame, name: str) -> DataFrame:
    """One row: what a level's prior is made from."""
    rate = F.col("good") / F.col("n")
    return level.where("n > 0").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum(F.col("n") * rate * rate).alias("square"), F.sum(F.lit(1)).alias("members")).withColumn("level", F.lit(name))


def _strength(row) -> float:
    """Strength of the prior from the rates of a level's members."""
    if not row.n or row.members < 2:
        return STRENGTH[0]
    mean = row.good / row.n
    binomial = mean * (1 - mean)
    # E[n (rate - mean)^2] summed = binomial * members + (n - members) * variance between members, about
    between = (row.square - row.n * mean * mean - binomial * (row.members - 1)) / max(row.n - row.members, 1)
    if binomial == 0 or between <= 0:
        return STRENGTH[1]
    return min(max(binomial / between - 1, STRENGTH[0]), STRENGTH[1])


def host_reputation(pages: DataFrame, outcomes: DataFrame, two_label_suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, labelled long, good long, mean and upper double for every host of ``pages`` (page_id, url).

    ``outcomes``: page_id, good (1 or 0); null outcomes and ids count for nothing, repeated rows count
    each time.  With no outcomes at all every mean is 0.5.  Hosts are counted once and written; all
    levels are made from that.
    """
    known = outcomes.where(F.col("good").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    host, _ = split_url(F.col("url"))
    hosts = pages.select("page_id", host.alias("host")).join(known, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    suffix, domain = suffix_and_domain(F.col("host"), two_label_suffixes)
    hosts = Workspace(pages.sparkSession).write(hosts.withColumns({"suffix": suffix, "domain": domain}), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    levels = {r.level: r for r in _moments(suffixes, "suffix").unionByName(_moments(domains, "domain")).unionByName(_moments(hosts, "host")).collect()}  # three rows
    total = levels["suffix"]
    mean = (total.good + 0.5) / (total.n + 1) if total.n else 0.5
    s0, s1, s2 = (_strength(levels[k]) for k in ("suffix", "domain", "host"))
    suffixes = suffixes.select("suffix", ((F.col("good") + s0 * mean) / (F.col("n") + s0)).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", ((F.col("good") + s1 * F.col("suffix_mean")) / (F.col("n") + s1)).alias("domain_mean"))
    a = F.col("good") + s2 * F.col("domain_mean")
    weight = F.col("n") + s2
    sd = F.sqrt((a / weight) * (1 - a / weight) / (weight + 1))
    return hosts.join(domains, ["suffix", "domain"]).select("host", F.col("n").alias("labelled"), "good", (a / weight).alias("mean"), (a / weight + Z * sd).alias("upper"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], min_good: float = MIN_GOOD, two_label_suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, mean, upper.

    A null or malformed url has an empty host and path, which fits no rule and is judged as one host.
    Repeated rows get equal verdicts; columns besides page_id and url are neither read nor returned.
    """
    host, path = split_url(F.col("url"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("upper") < min_good, "block").otherwise("allow")
    judged = parted.join(host_reputation(pages, outcomes, two_label_suffixes), "host", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "mean", "upper")
