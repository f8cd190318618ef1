"""URL filters: rules on hosts and paths, and for all other urls the reputation of the host by empirical Bayes.

Reputation. Every labelled page is an outcome, bad or not. Outcomes are counted by host, registered domain and public suffix. The share of bad pages of
a host is drawn from a beta distribution about its domain's, that of a domain about its suffix's, that of a suffix about the share of all. How far
the nodes of a level lie from their parents (the intraclass correlation) is estimated from all nodes of that level by the method of moments, so a host
with few labels keeps close to its domain and one with many follows its own pages. No outcome counts twice: what a domain says of a host leaves out the host's
own pages, what a suffix says of a domain the domain's. What is not known of the parent's share widens the prior. A host is blocked if the lower bound of
its posterior, ``z`` standard deviations under the mean, lies above ``most_bad``.

Plan. Pages meet outcomes by id; counts by host are summed before they are shuffled, so that a host that holds a third of all pages is a
few rows; levels above are sums of those. What a host's rules and reputation say is worked out once a host and joined to the pages, where the hot host is
a skewed left side, which AQE splits. The driver sees four sums a level. Rules are a parameter of at most ``MOST_RULES``.

Defined results: a null url, or one without ``://``, has an empty host and path, and its pages form one host; a null id has no outcome; repeated rows are
judged each, and each of their outcomes counts; of repeated labels of an id one bad one is enough, and an id whose labels are all null has none; without any
outcome the method allows all; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

MOST_RULES = 100_000
#: Share of bad pages above which a host is blocked.
MOST_BAD = 0.3
#: Standard deviations from the posterior mean to its lower bound: one-sided 95 %.
Z = 1.645
#: Bounds of the intraclass correlation of a level, and its value where no node has two outcomes.
LEAST_RHO, MOST_RHO, SOME_RHO = 0.001, 0.99, 0.1
#: Public suffixes of two labels that are told from registered domains; all others are the last label.
TWO_LABELS = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "gov.uk", "org.au", "org.uk")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z lower-cased; empty for null and where there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_levels(hosts: DataFrame) -> DataFrame:
    """Adds domain and suffix of host. Names of users, ports and a dot at the end don't count; an address of digits is its own domain and suffix."""
    bare = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), "(:[0-9]*)?$", "")
    hosts = hosts.withColumn("_bare", F.regexp_replace(bare, r"\.$", ""))
    last = lambda n: F.substring_index("_bare", ".", -n)
    two = last(2).isin(*TWO_LABELS)
    number = F.col("_bare").rlike(r"^[0-9.]*$|^\[")
    suffix = F.when(number, F.col("_bare")).when(two, last(2)).otherwise(last(1))
    domain = F.when(number, F.col("_bare")).when(two, last(3)).otherwise(last(2))
    return hosts.withColumns({"domain": domain, "suffix": suffix}).drop("_bare")


def _rho(level: DataFrame) -> float:
    """Intraclass correlation of nodes (n, bad) about the means ``mu``, by the weighted sum of squares and its expectation."""
    v = F.col("mu") * (1 - F.col("mu"))
    off = F.col("bad") / F.col("n") - F.col("mu")
    seen = level.where("n > 0")
    found = seen.agg(F.sum(F.col("n") * off * off).alias("s"), F.sum(v).alias("v"), F.sum(v * (F.col("n") - 1)).alias("more")).first()
    if not found["more"]:
        return SOME_RHO
    return min(MOST_RHO, max(LEAST_RHO, (found["s"] - found["v"]) / found["more"]))


def _shrunk_by(level: DataFrame, rho: float, n: str, bad: str) -> DataFrame:
    """Adds a and b of the beta distribution of a share that is drawn, with correlation ``rho``, about one of mean ``mu`` and variance ``var``, and has been seen in ``n`` outcomes."""
    most = F.col("mu") * (1 - F.col("mu"))
    kappa = most / (F.lit(rho) * (most - F.col("var")) + F.col("var")) - 1
    return level.withColumn("_kappa", kappa).withColumns({"a": F.expr(bad) + F.col("_kappa") * F.col("mu"), "b": F.expr(f"{n} - ({bad})") + F.col("_kappa") * (1 - F.col("mu"))}).drop("_kappa")


def _as_prior(level: DataFrame) -> DataFrame:
    """mu and var of the distribution (a, b)."""
    n = F.col("a") + F.col("b")
    return level.withColumns({"mu": F.col("a") / n, "var": F.col("a") * F.col("b") / (n * n * (n + 1))}).drop("a", "b")


def reputations(counts: DataFrame) -> DataFrame:
    """host, n, bad, a and b of each host's posterior, from counts by host (host, n, bad)."""
    total = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not total["n"]:
        return counts.withColumns({"a": F.lit(0.0), "b": F.lit(1.0)})
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    hosts = with_levels(counts)
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums).withColumns({"mu": F.lit((total["bad"] + 1) / (total["n"] + 2)), "var": F.lit(0.0)})
    renamed = lambda df, end: df.withColumnsRenamed({"n": f"n_{end}", "bad": f"bad_{end}"})
    rho = _rho(suffixes)
    # what a domain's suffix says without the domain itself, and what a host's domain says without the host
    at = domains.join(renamed(suffixes, "suffix"), "suffix")
    domains = _as_prior(_shrunk_by(at, rho, "n_suffix - n", "bad_suffix - bad"))
    rho = _rho(domains)
    at = hosts.join(renamed(domains, "domain").select("domain", "suffix", "n_domain", "bad_domain", "mu", "var"), ["domain", "suffix"])
    hosts = _as_prior(_shrunk_by(at, rho, "n_domain - n", "bad_domain - bad"))
    return _shrunk_by(hosts, _rho(hosts), "n", "bad").select("host", "n", "bad", "a", "b")


def lower_bound(z: float = Z) -> Column:
    """``z`` standard deviations under the mean of the beta distribution of columns a and b, 0 at least."""
    a, b = F.col("a"), F.col("b")
    n = a + b
    return F.greatest(F.lit(0.0), a / n - F.lit(z) * F.sqrt(a * b / (n * n * (n + 1))))


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """host and says, the rules of the host (length, verdict, path, rule)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    listed = json.dumps([{"host": r.host, "length": len(r.host + r.path), "verdict": r.verdict, "path": r.path, "rule": r.host + r.path} for r in rules])
    each = spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<host:string,length:int,verdict:string,path:string,rule:string>>")))
    return each.groupBy("host").agg(F.collect_list(F.struct("length", "verdict", "path", "rule")).alias("says"))


def host_rules(hosts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """host and all rules that fit it: its own and those of the hosts that it is a subdomain of."""
    labels = F.split("host", r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.select("host", F.explode(ends).alias("_end"))
    found = each.join(F.broadcast(rule_table(hosts.sparkSession, rules).withColumnRenamed("host", "_end")), "_end")
    return found.groupBy("host").agg(F.flatten(F.collect_list("says")).alias("says"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, most_bad: float = MOST_BAD, z: float = Z, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, bad_bound (of the host) and n_labelled (of the host).

    ``outcomes`` has the id and bad (boolean) of labelled pages; of several rows of an id one bad one is enough.
    """
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    told = outcomes.where(F.col("bad").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("bad").alias("_bad"))
    counts = urls.join(told, "_id", "left").groupBy("host").agg(F.count("_bad").alias("n"), F.count(F.when(F.col("_bad"), 1)).alias("bad"))
    counts = materialise(counts, "host-outcomes")
    hosts = reputations(counts).select("host", "n", lower_bound(z).alias("_bound")).join(host_rules(counts, rules), "host", "left")
    at = urls.join(hosts, "host", "left")
    fitting = F.filter("says", lambda s: F.startswith(F.col("path"), s["path"]))
    at = at.withColumn("_rule", F.array_max(fitting))
    blocked = F.when(F.col("_bound") > most_bad, "block").otherwise("allow")
    return at.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", blocked).alias("verdict"), F.round("_bound", 6).alias("bad_bound"), F.col("n").alias("n_labelled"))


def label_outcomes(labels: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Outcomes from labels (doc_id, quality, toxic): bad where the quality is 0 or the page is toxic, good where neither is said."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), True).when(F.coalesce("quality", "toxic").isNotNull(), False)
    return labels.select(F.col("doc_id").alias(id_col), bad.alias("bad"))
