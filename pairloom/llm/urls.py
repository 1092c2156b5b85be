"""URL filter: listed rules, and for all other pages the standing of the host in the link graph.

Trust spreads from hosts whose pages the rules mostly allow along links;
distrust spreads from hosts whose pages they mostly block against the direction
of links, for who links to blocked hosts is suspect.  Both are personalised
PageRanks over host edges, kept as whole numbers so that no order of summing
matters.  Nothing runs in Python.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.session import materialise


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)
# After so many steps at most 0.85^20, 4 %, of a seed's rank is still on its way.
ROUNDS = 20
# Of 100; the rest returns to the seeds.
DAMPING = 85
# Rank of all seeds together, and the parts of one unit in which ranks are kept, so that small shares last.
MASS = 10**12
PARTS = 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for a null url and for one without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def matched(rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits the columns host and path, as a struct (rule, verdict), else null."""
    cases = []
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        cases.append(F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))))
    return F.coalesce(*cases)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: absolute links in href attributes between different hosts, counted."""
    links = F.regexp_extract_all("html", F.lit("(?i)\\bhref\\s*=\\s*[\"']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\\s>]*)"), F.lit(1))
    found = pages.select(host_and_path(F.col("url"))[0].alias("src"), F.explode(links).alias("link"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    edges = found.select("src", host_and_path(target)[0].alias("dst"))
    return edges.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def seeds(judged: DataFrame) -> DataFrame:
    """side, host, rank: hosts of which the rules allow (side 0) or block (side 1) more than half of the pages.

    Each side's mass is shared equally.
    """
    hosts = judged.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(F.col("hit.verdict") == v, 1)).alias(v) for v in ("allow", "block")],
    )
    sided = hosts.select("host", F.when(F.col("allow") * 2 > F.col("n"), 0).when(F.col("block") * 2 > F.col("n"), 1).alias("side")).where("side IS NOT NULL")
    sided = materialise(sided)
    sizes = sided.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    return sided.join(sizes, "side").select("side", "host", F.expr(f"{MASS * PARTS} div n").alias("rank"))


def _shares(edges: DataFrame) -> DataFrame:
    """side, host, to, n, all (links of the host): links as trust follows them, and reversed as distrust does."""
    both = edges.select(F.lit(0).alias("side"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionByName(
        edges.select(F.lit(1).alias("side"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    )
    sums = both.groupBy("side", "host").agg(F.sum("n").alias("all"))
    return both.join(sums, ["side", "host"]).select("side", "host", "to", "n", "all")


def _part(rank: str, n: str, of: str) -> Column:
    """rank * n / of, rounded down; the product has up to 38 digits."""
    long = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    return F.expr(f"{long(rank)} * {long(n)} div {long(of)}")


def propagate(start: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """side, host, rank after some rounds of personalised PageRank from the seeds."""
    shares = materialise(_shares(edges))
    base = materialise(start.select("side", "host", _part("rank", str(100 - DAMPING), "100").alias("rank")))
    if shares.isEmpty():
        # Nothing moves, so a seed keeps what returns to it.
        return base
    ranks = start
    for _ in range(rounds):
        moved = (
            ranks.join(shares, ["side", "host"])
            .groupBy("side", F.col("to").alias("host"))
            .agg(F.sum(_part("rank", "n", "all")).alias("rank"))
            .select("side", "host", _part("rank", str(DAMPING), "100").alias("rank"))
        )
        ranks = materialise(base.unionByName(moved).groupBy("side", "host").agg(F.sum("rank").alias("rank")))
    return ranks


def host_verdicts(ranks: DataFrame) -> DataFrame:
    """host, standing: block where distrust is greater than trust.

    Both sides have the same mass in all, so the comparison depends neither on
    the number of hosts nor on that of the seeds.
    """
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("rank"))), F.lit(0))
    sides = ranks.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"))
    return sides.select("host", F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow").alias("standing"))


def filtered(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    A page without a rule takes its host's standing; hosts that neither trust
    nor distrust reaches within `rounds` links, and pages without a host, are
    allowed.  Repeated rows
    each get a row.  An empty table gives an empty result; other columns are
    ignored.
    """
    host, path = host_and_path(F.col("url"))
    judged = materialise(pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("hit", matched(rules)))
    start = materialise(seeds(judged))
    standing = materialise(host_verdicts(propagate(start, materialise(host_edges(pages)), rounds)))
    return judged.join(standing, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", "standing", F.lit("allow")).alias("verdict"),
    )
