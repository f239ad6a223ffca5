"""URL filter by host reputation: empirical-Bayes shrinkage from host to registered domain to suffix.

Labelled page outcomes are counted per host, domain and suffix. At each level the rates vary round those
of the level above with a correlation estimated from all groups of the level (the moment estimator of a
beta-binomial), and a group's posterior is its own counts plus the prior so found. A page is blocked
where the lower bound of its host's posterior bad rate is above a limit. Listed rules come first.

Everything is DataFrame expressions. Only a handful of sums per level come to the driver.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import cut_lineage

#: Everything up to the first "://", then host and path.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, below a path: ``Rule("block", "example.com/de/")``."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2] if "/" in self.rule else ""


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def _domain(host: Column, long_suffixes: Sequence[str]) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, its port left out."""
    plain = F.regexp_replace(host, r":[0-9]*\z", "")
    two = F.regexp_extract(plain, r"([^.]*\.[^.]*)\z", 1)
    three = F.regexp_extract(plain, r"([^.]*\.[^.]*\.[^.]*)\z", 1)
    long = two.isin(*long_suffixes) if long_suffixes else F.lit(False)
    domain = F.when(long & (three != ""), three).when(two != "", two).otherwise(plain)
    suffix = F.when(long, two).otherwise(F.regexp_extract(plain, r"([^.]*)\z", 1))
    return domain, suffix


def _with_posterior(groups: DataFrame, floor: float) -> DataFrame:
    """Add the posterior counts ``a`` (bad) and ``b`` (good) to groups with ``n, bad`` and the rate above, ``above``."""
    spread = F.col("above") * (1 - F.col("above"))
    sums = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("above"), F.lit(2.0))).alias("found"),
        F.sum(spread).alias("expected"),
        F.sum((F.col("n") - 1) * spread).alias("weight"),
    )
    row = sums.first()
    correlation = (row["found"] - row["expected"]) / row["weight"] if row["weight"] else floor
    correlation = min(max(correlation, floor), 1 - floor)
    strength = 1 / correlation - 1
    return groups.withColumns(
        {
            "a": F.col("bad") + strength * F.col("above"),
            "b": F.col("n") - F.col("bad") + strength * (1 - F.col("above")),
        }
    )


def _with_group(rows: DataFrame, groups: DataFrame, key: str, members: str, salt: Sequence[str], parts: int) -> DataFrame:
    """Each row with the columns of its group; ``members`` of a group is the number of its rows.

    A group of more than one ``parts``-th of all rows is repeated and its rows are dealt by ``salt``, so that no key
    of the join has a larger share. Such groups are fewer than ``parts``, which bounds what is broadcast.
    """
    total = groups.agg(F.coalesce(F.sum(members), F.lit(0)).alias("n")).first()["n"]
    share = max(1, -(-total // parts))
    groups = groups.withColumn("split", F.ceil(F.col(members) / share).cast("int")).drop(members)
    several = F.broadcast(groups.where("split > 1").select(key, "split"))
    part = F.coalesce(F.pmod(F.xxhash64(*salt), F.col("split")).cast("int"), F.lit(0))
    dealt = rows.join(several, key, "left").withColumn("part", part).drop("split")
    repeated = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("split") - 1))).drop("split")
    return dealt.join(repeated, [key, "part"], "left").drop("part")


def host_reputation(
    pages: DataFrame,
    bad: Column,
    long_suffixes: Sequence[str] = (),
    z: float = 1.645,
    floor: float = 1e-4,
    parts: int = 4096,
) -> DataFrame:
    """Per host: labelled pages ``n``, ``bad`` ones, all ``pages``, posterior ``rate`` and its ``lower`` bound.

    ``pages`` has a url column; ``bad`` says whether a page is bad, null where it has no label. Hosts
    without labelled pages get the prior of their domain.
    """
    counts = pages.select(host_of(F.col("url")).alias("host"), bad.cast("boolean").alias("outcome")).groupBy("host").agg(
        F.count("outcome").alias("n"), F.count(F.when(F.col("outcome"), 1)).alias("bad"), F.count(F.lit(1)).alias("pages")
    )
    domain, suffix = _domain(F.col("host"), long_suffixes)
    hosts = cut_lineage(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad", "pages"))
    rate = F.col("a") / (F.col("a") + F.col("b"))
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("members"))
    domains = cut_lineage(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = cut_lineage(domains.groupBy("suffix").agg(*sums))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    root = (total["bad"] + 0.5) / (total["n"] + 1)
    suffixes = _with_posterior(suffixes.withColumn("above", F.lit(root)), floor).select("suffix", "members", rate.alias("above"))
    domains = cut_lineage(_with_group(domains, suffixes, "suffix", "members", ["domain"], parts))
    domains = _with_posterior(domains, floor).select("domain", "members", rate.alias("above"))
    hosts = cut_lineage(_with_group(hosts, domains, "domain", "members", ["host"], parts))
    a, b = F.col("a"), F.col("b")
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return _with_posterior(hosts, floor).select(
        "host", "n", "bad", "pages", rate.alias("rate"), F.greatest(rate - z * sd, F.lit(0.0)).alias("lower")
    )


def _rules_of_hosts(hosts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per host that any rule fits: those rules, longest first."""
    listed = hosts.sparkSession.createDataFrame(
        [(r.host, r.path, r.rule, r.verdict) for r in rules],
        "above string, rule_path string, rule string, rule_verdict string",
    )
    labels = F.split("host", r"\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fitting = hosts.select("host", F.explode(above).alias("above")).join(listed, "above")
    entry = F.struct((-F.length("rule")).alias("order"), "rule", "rule_path", "rule_verdict")
    return fitting.groupBy("host").agg(F.sort_array(F.collect_list(entry)).alias("rules"))


def judge_urls(
    pages: DataFrame,
    bad: Column,
    rules: Sequence[Rule] = (),
    limit: float = 0.5,
    long_suffixes: Sequence[str] = ("co.uk", "org.uk", "com.au", "co.jp", "com.br"),
    z: float = 1.645,
    parts: int = 4096,
) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict, host_pages, host_bad, rate, lower``.

    ``pages`` has page_id and url; ``bad`` is a column over ``pages``. The longest fitting rule decides,
    else the page is blocked if ``lower > limit``. A null url, or one without "://", has an empty host and
    path and is judged by the reputation of the empty host. Repeated rows are judged each, other columns
    are not returned, an empty table gives no rows. A rule list is the caller's own and small. The pages of a
    host that has more than one ``parts``-th of them are joined in several parts.
    """
    reputation = cut_lineage(host_reputation(pages, bad, long_suffixes, z, parts=parts))
    if rules:
        reputation = reputation.join(_rules_of_hosts(reputation.select("host"), rules), "host", "left")
    else:
        reputation = reputation.withColumn(
            "rules", F.lit(None).cast("array<struct<order:int,rule:string,rule_path:string,rule_verdict:string>>")
        )
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # Every host of the pages is in the table, so the outer join finds a row for each and keeps every page.
    judged = _with_group(urls, reputation, "host", "pages", ["page_id", "path"], parts)
    first = F.try_element_at(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(1))
    own = F.when(F.col("lower") > limit, "block").otherwise("allow")
    return judged.withColumn("first", first).select(
        "page_id",
        "host",
        "path",
        F.col("first.rule").alias("rule"),
        F.coalesce("first.rule_verdict", own).alias("verdict"),
        F.col("n").alias("host_pages"),
        F.col("bad").alias("host_bad"),
        "rate",
        "lower",
    )
