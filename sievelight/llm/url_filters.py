"""URL filters: prefix rules first, then link-graph propagation for the rest. DataFrame functions only.

Trust flows forward along host links by personalised PageRank from the hosts of allow rules; distrust flows
backward from the hosts of block rules. A host whose distrust exceeds its trust by more than ``threshold`` is
blocked; its pages without a rule of their own follow.

Links are counted per pair of hosts before anything is joined, so a host with a third of all pages is one row per
linked host. Iterates are cut by checkpoints every few rounds.

Edge cases: a null url or one without ``://`` has empty host and path and is allowed; dangling hosts return their
mass to the seeds; without seeds nobody is blocked; repeated pages count as often as they occur; equal scores
allow; null html has no links, and html of any length is read whole; columns named like a result are replaced, other
extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed rules of the contract: (verdict, host, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'>\s]*://[^"'>\s]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: tuple[str, str, str], host: Column, path: Column) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict): the longest fitting rule, by characters of host and path; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        name = F.when(_fits(r, host, path), r[1] + r[2]).otherwise(name)
        verdict = F.when(_fits(r, host, path), r[0]).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links between different hosts, counted."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))).alias("url"))
    return links.select("src", host_of(F.col("url")).alias("dst")).where("dst <> '' AND src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, reverse: bool = False, rounds: int = 8, damping: float = 0.85) -> DataFrame:
    """(host, score) by personalised PageRank over (src, dst, n) from seeds (host, weight); weights are shares of 1.

    Every round starts from a written table, so plans don't grow with the rounds; the mass on hosts without outgoing
    edges, one number, goes back to the seeds. Without edges the seeds keep all of it.
    """
    if reverse:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    score = seeds.select("host", F.col("weight").alias("score")).checkpoint()
    if edges.isEmpty():
        return score
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    steps = edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")).checkpoint()
    leaving, base = steps.select("src").distinct().checkpoint(), score
    for _ in range(rounds):
        stuck = score.join(leaving, score.host == leaving.src, "left_anti").agg(F.sum("score")).first()[0] or 0.0
        moved = steps.join(score, steps.src == score.host).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("score") * F.col("share")) * damping).alias("score"))
        home = base.select("host", (F.col("score") * F.lit(1 - damping + damping * stuck)).alias("score"))
        score = home.unionByName(moved).groupBy("host").agg(F.sum("score").alias("score")).checkpoint()
    return score


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.0, rounds: int = 8) -> DataFrame:
    """Every page with host, path, rule and verdict, and its host's trust and distrust."""
    known = pages.drop("host", "path", "rule", "by_rule", "verdict", "trust", "distrust").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    known = known.withColumns({"rule": rule, "by_rule": verdict})
    edges = host_edges(known).checkpoint()
    ruled = known.where("host <> '' AND by_rule IS NOT NULL").groupBy("host", "by_rule").agg(F.count("*").alias("n"))

    def seeds(kind: str) -> DataFrame:
        own = ruled.where(F.col("by_rule") == kind)
        total = own.agg(F.sum("n")).first()[0] or 1
        return own.select("host", (F.col("n") / F.lit(total)).alias("weight"))

    trust = propagate(edges, seeds("allow"), rounds=rounds).select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust"))
    distrust = propagate(edges, seeds("block"), reverse=True, rounds=rounds).select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust"))
    scores = trust.unionByName(distrust).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    judged = known.drop("html").join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    return judged.withColumn("verdict", F.coalesce("by_rule", F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")))
