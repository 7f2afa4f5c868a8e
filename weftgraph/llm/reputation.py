"""URL filter by rules and by empirical-Bayes host reputation.

Page outcomes (bad, not bad or unknown) are counted by host; they may be labels, or
come from the pages themselves by page_outcomes(). The share of bad pages is shrunk towards its parent: hosts towards their registered domain, domains
towards their public suffix, suffixes towards the whole. Each level has one
beta-binomial prior whose strength comes from the spread between its groups
(method of moments). A page is blocked when the lower bound of its host's
posterior share exceeds a limit, so thin evidence does not block. Rules on host
and path go first, the longest one wins.

Only DataFrame functions run. Groups are summed before they are shuffled, and a
host's pages are never gathered: pages meet their host's verdict in an equi-join
that adaptive execution splits when one host is hot.

Defined cases: a null url or one without `://` has an empty host and path, and
is judged as the host ''. Without outcomes the prior blocks nothing. Repeated
pages are judged one by one, each a page of its own for the counts; a page with two
outcomes counts twice; a null page_id has no outcome. Hosts without a dot are their
own domain and suffix. Empty tables give empty results. Columns besides page_id,
url and, for page_outcomes(), html are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, pick

MAX_RULES = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Public suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "co.za", "com.br", "com.cn", "com.mx",
    "com.tr", "com.tw", "co.in", "co.kr", "github.io", "blogspot.com",
)


# Words of advertising for gambling and pills, and signs that prose seldom has.
SPAM_WORDS = ("casino", "pills", "bets", "lottery", "payday")
JUNK_SIGNS = "#*$%|"


@dataclass(frozen=True)
class Limits:
    """Block when mean - z * deviation of the posterior exceeds max_bad."""

    max_bad: float = 0.30
    z: float = 1.2816
    least_strength: float = 0.5
    most_strength: float = 1000.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or two where names are registered below two."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one more label."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def page_outcomes(pages: DataFrame, junk_percent: int = 5) -> DataFrame:
    """page_id, bad: what a page's own html says of it.

    Bad is a page with a spam word anywhere in its html, or with more than
    junk_percent of 100 characters outside of tags being junk signs. Null html is
    unknown, html without text is not bad.
    """
    html = F.col("html")
    text = F.regexp_replace(html, "<[^>]*>", " ")
    signs = F.length(text) - F.length(F.translate(text, JUNK_SIGNS, ""))
    spam = html.rlike(f"(^|[^0-9A-Za-z])(?i:{'|'.join(SPAM_WORDS)})([^0-9A-Za-z]|$)")
    bad = F.when(html.isNotNull(), (spam | (signs * 100 > F.length(text) * junk_percent)).cast("int"))
    return pick(pages, "page_id", "html").select("page_id", bad.alias("bad"))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _shrink(groups: DataFrame, limits: Limits) -> DataFrame:
    """Strength of the prior of one level from (n, k, parent mean m), and the posterior of each group.

    Var(k) = n m (1 - m) (1 + (n - 1) rho); strength = 1 / rho - 1.
    """
    plain = F.col("n") * F.col("m") * (1 - F.col("m"))
    over = F.sum((F.col("k") - F.col("n") * F.col("m")) ** 2 - plain)
    rho = F.try_divide(over, F.sum(plain * (F.col("n") - 1)))
    strength = groups.agg(F.greatest(F.lit(limits.least_strength), F.least(F.lit(limits.most_strength), F.when(rho > 0, 1 / rho - 1).otherwise(limits.most_strength))).alias("strength"))
    strength = strength.select(F.coalesce("strength", F.lit(limits.most_strength)).alias("strength"))
    return groups.crossJoin(F.broadcast(strength))  # one row: the level's prior


def host_posteriors(pages: DataFrame, outcomes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """host, domain, suffix, n, k, mean, deviation for every host of pages.

    outcomes has page_id and bad (0 or 1, null unknown).
    """
    seen = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"))
    known = pick(outcomes, "page_id", "bad").where("page_id IS NOT NULL AND bad IN (0, 1)")
    hosts = cut(
        seen.join(known, "page_id", "left").groupBy("host")
        .agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
        .select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k")
    )
    # Each level is summed once; the levels below read the sums, not the pages.
    sums = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = cut(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = cut(domains.groupBy("suffix").agg(*sums))
    whole = suffixes.agg(*sums).select(((F.coalesce("k", F.lit(0.0)) + 1) / (F.coalesce("n", F.lit(0.0)) + 20)).alias("m"))
    mean = (F.col("k") + F.col("strength") * F.col("m")) / (F.col("n") + F.col("strength"))
    level = cut(_shrink(suffixes.crossJoin(F.broadcast(whole)), limits).select("suffix", mean.alias("m")))  # one row: the whole
    level = cut(_shrink(cut(domains.join(level, "suffix")), limits).select("domain", mean.alias("m")))
    level = _shrink(cut(hosts.join(level, "domain")), limits)
    total = F.col("n") + F.col("strength")
    return level.select("host", "domain", "suffix", "n", "k", mean.alias("mean"), F.sqrt(mean * (1 - mean) / (total + 1)).alias("deviation"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], limits: Limits = Limits()) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_share, bad_bound of every page."""
    table = host_posteriors(pages, outcomes, limits).select(
        "host", F.col("mean").alias("bad_share"), (F.col("mean") - limits.z * F.col("deviation")).alias("bad_bound")
    )
    seen = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > limits.max_bad, "block").otherwise("allow")
    return seen.join(table, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_share", "bad_bound")
