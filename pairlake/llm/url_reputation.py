"""URL filters: allow and block rules, then empirical-Bayes host reputation.

Reputation of a host is the posterior of its bad-page rate under a chain of
beta-binomial priors: all labelled pages -> public suffix -> registered domain ->
host. At each level the prior mean is the posterior mean one level up, and the prior
strength is the method-of-moments estimate from the spread of the children's rates
around it. A page is blocked when the lower posterior bound of its host's bad rate
exceeds a limit, so that hosts with few labelled pages are judged by their domain, and
unknown ones by the suffix. The bound is the normal approximation of the beta
posterior, its mean less ``z`` standard deviations, as there is no beta quantile among
the SQL functions; it is below the exact quantile for the rare rates that matter, so it
errs towards allowing.

Reputation is by the name in a host, without user information, port and final dots.
The public suffix is the last label, or the last two where the last is a country's and
the one before is one of ``SECOND_LEVEL`` (co.uk, com.br): a rule in place of the
public-suffix list, whose other entries count as registered domains. An IPv4 address
is its own registered domain under one suffix of all addresses.

Only DataFrame operations are used. One pass counts labelled pages per host; the
levels above are aggregates of that table, and each level's table is cut from its
lineage, so that the plan does not grow with the levels. Tables are broadcast below a
counted size; beyond it, each key's rows are dealt to several tasks.

Defined results: a null url, or one without "://", has an empty host and path and
no rule. A host whose suffix has no labelled page has no reputation (null rate) and
is allowed. Null labels do not count. Repeated labels of one page count once
each. Extra columns are ignored, and repeated page rows are each judged; a null
page_id is reported as such.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, with_small

#: (verdict, host, path prefix): fixed values of the job.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Weakest and strongest prior, as a number of pages.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0

#: Labels that make a public suffix with a country's, as a pattern of names; IPv4 addresses, and what stands for their suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")
TWO_LABELS = r"(^|[.])(" + "|".join(SECOND_LEVEL) + r")[.][a-z][a-z]$"
ADDRESS, ADDRESSES = r"^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$", "(address)"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def name_of(host: Column) -> Column:
    """A host without user information, port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", ""), r"[.]+\z", "")


def registered_domain(name: Column) -> Column:
    return F.when(name.rlike(ADDRESS), name).when(name.rlike(TWO_LABELS), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def suffix(name: Column) -> Column:
    return F.when(name.rlike(ADDRESS), ADDRESSES).when(name.rlike(TWO_LABELS), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(children: DataFrame, prior: Column, key: str) -> DataFrame:
    """Method of moments per group: n_bad, n_all, prior -> alpha + beta of the prior.

    Var(k/n) = p(1-p)/n * (1 + (n-1)/(s+1)), summed over the children with two
    pages or more: the share of the spread that binomial noise cannot explain is
    rho = 1/(s+1).
    """
    n, k = F.col("n_all").cast("double"), F.col("n_bad").cast("double")
    over = F.sum(F.when(n > 1, F.pow(k - n * prior, F.lit(2.0)) - n * prior * (1 - prior)).otherwise(0.0))
    unit = F.sum(F.when(n > 1, n * (n - 1) * prior * (1 - prior)).otherwise(0.0))
    rho = F.when(unit > 0, over / unit).otherwise(F.lit(0.0))
    s = F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(MOST_STRENGTH))
    return children.groupBy(key).agg(F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), s)).alias("strength"))


def reputation(outcomes: DataFrame, z: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(host, bad) rows of labelled pages -> tables by host, domain and suffix.

    Each has its key, ``rate`` (posterior mean), ``bound`` (lower posterior bound)
    and ``weight``.
    """
    count = [F.count("bad").alias("n_all"), F.sum("bad").alias("n_bad")]
    total = [F.sum("n_all").alias("n_all"), F.sum("n_bad").alias("n_bad")]
    named = outcomes.select(name_of(F.col("host")).alias("name"), "bad").where(F.col("bad").isNotNull() & (F.col("name") != ""))
    hosts = named.groupBy("name").agg(*count)
    hosts = cut(hosts.withColumns({"domain": registered_domain(F.col("name")), "suffix": suffix(F.col("name"))}))
    domains = cut(hosts.groupBy("domain", "suffix").agg(*total))
    suffixes = cut(domains.groupBy("suffix").agg(*total).withColumn("root", F.lit("")))
    seen = suffixes.agg(*total).first()
    # before any label is seen the rate is one half, by two pseudo-pages
    world = suffixes.select("root").distinct().withColumn("prior", F.lit(((seen["n_bad"] or 0) + 1) / ((seen["n_all"] or 0) + 2)))

    def level(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        """Posterior of the children, given ``prior`` of the parents."""
        with_prior = with_small(children, parents, key)
        out = with_small(with_prior, cut(_strength(with_prior, F.col("prior"), key)), key)
        weight = F.col("n_all") + F.col("strength")
        out = out.withColumn("rate", (F.col("n_bad") + F.col("strength") * F.col("prior")) / weight).withColumn("weight", weight)
        return cut(out.withColumn("bound", F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))))

    s = level(suffixes, cut(world), "root")
    d = level(domains, s.select("suffix", F.col("rate").alias("prior")), "suffix")
    h = level(hosts, d.select("domain", F.col("rate").alias("prior")), "domain")
    return h, d, s


def judge(pages: DataFrame, outcomes: DataFrame, limit: float = 0.3, z: float = 2.0, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, url -> page_id, host, path, rule, verdict, bad_rate, bad_bound.

    ``outcomes`` has (url, bad) for the labelled pages, bad being 0, 1 or null.
    """
    labelled = outcomes.select(host_of(F.col("url")).alias("host"), F.col("bad").cast("long").alias("bad"))
    h, d, s = reputation(labelled, z)
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # the hosts that occur are far fewer than the pages: resolve each host once
    known = seen.select("host").distinct().withColumn("name", name_of(F.col("host")))
    known = cut(known.withColumns({"domain": registered_domain(F.col("name")), "suffix": suffix(F.col("name"))}))
    for x, key in zip((h, d, s), ("name", "domain", "suffix")):
        known = with_small(known, x.select(key, F.col("rate").alias(f"{key}_rate"), F.col("bound").alias(f"{key}_bound")), key, "left")
    known = cut(known.select("host", F.coalesce("name_rate", "domain_rate", "suffix_rate").alias("bad_rate"), F.coalesce("name_bound", "domain_bound", "suffix_bound").alias("bad_bound")))
    found = match_rule(F.col("host"), F.col("path"), rules)
    return (
        with_small(seen, known, "host", "left")
        .withColumn("m", found)
        .select(
            "page_id", "host", "path", F.col("m.rule").alias("rule"),
            F.coalesce(F.col("m.verdict"), F.when(F.col("bad_bound") > limit, "block").otherwise("allow")).alias("verdict"),
            F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound"),
        )
    )
