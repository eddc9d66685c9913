"""URL filter: rules, and for the rest trust and distrust spread over the graph of links between hosts."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, small_join

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Share of a host's score that goes on along its links, the share of the seeds' sum that may still be on its way at
#: the end, and what a host must show to be blocked: more than LEAST of distrust, where 1 is the mean host's, and
#: FACTOR times its trust.
DAMPING, RESIDUAL, LEAST, FACTOR = 0.85, 1e-3, 0.5, 1.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; empty without ://."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from a host's pages to another host. Links without a host stay on their own."""
    targets = F.array_distinct(F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"), 1))
    lower = F.translate(F.col("dst"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    linked = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).withColumn("dst", lower)
    return linked.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, scratch: Scratch, name: str, residual: float = RESIDUAL) -> DataFrame:
    """Personalised PageRank: (host, score, arrived) of the hosts that the seeds (host, seed) reach; the seeds' sum is kept below 1.

    arrived: the part of the score that came over links, which is all but what the host's own seed puts in.

    A host gives DAMPING of its score to the hosts that it links to, by the number of pages with such a link; what a
    host without links would give goes nowhere, so a host that nothing trusted reaches has no score. Each round moves
    on what came in the round before, a sum that shrinks to DAMPING of itself or less, until no more than `residual` of
    the seeds' sum is under way: the scores then lack less than that of their limits, all hosts together. A round reads
    and writes tables of hosts; only that sum comes to the driver. Contributions are summed before the shuffle.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    shares = scratch.table(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), f"{name}-shares")
    total = seeds.agg(F.sum("seed")).first()[0] or 1.0
    start = scratch.table(seeds.where(F.col("seed") > 0).select("host", (F.col("seed") / F.lit(float(total))).alias("score")), f"{name}-0")
    if shares.isEmpty() or start.isEmpty():
        return start.withColumn("arrived", F.lit(0.0))
    none, stays = F.lit(0.0), F.col("going") * (1 - DAMPING)
    rank = start.select("host", F.col("score").alias("going"), (F.col("score") * (1 - DAMPING)).alias("score"), none.alias("arrived"))
    for k in itertools.count(1):
        moving = rank.where("going > 0").select(F.col("host").alias("src"), "going")
        sent = shares.join(moving, "src").select(F.col("dst").alias("host"), (F.col("share") * F.col("going") * DAMPING).alias("going"), none.alias("score"), none.alias("arrived"))
        sums = sent.unionByName(rank.withColumn("going", none)).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("going", "score", "arrived")])
        rank = scratch.table(sums.select("host", "going", (F.col("score") + stays).alias("score"), (F.col("arrived") + stays).alias("arrived")), f"{name}-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 1}")
        if rank.agg(F.sum("going")).first()[0] <= residual:
            return rank.select("host", "score", "arrived")


def judge(pages: DataFrame, scratch: Scratch, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Verdicts for pages (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    A page that a rule fits gets the rule's verdict. Others get their host's: trust spreads from hosts with allowed
    pages along links, distrust from hosts with blocked pages against them (who links to blocked hosts is suspect).
    A seed weighs the share of its allowed or blocked pages in all the host's. Scores are taken times the
    number of hosts, so that 1 is the mean: block if distrust > LEAST and distrust > FACTOR * trust, else allow.
    A host with half of its pages blocked or fewer is judged on the distrust that links bring, without what its own
    seed puts in, so that its clean pages stay; the column distrust is the whole score.
    Null urls and urls without :// have an empty host, which no rule fits and no link reaches: allow. Null html
    has no links. Rows are kept as they are, repeated ones too; further columns don't matter.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    edges = scratch.table(host_edges(parsed), "edges")
    judged = scratch.table(parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule")), "judged")
    named = judged.where(F.col("host") != "").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
    named = scratch.table(named, "hosts")
    hosts = named.select("host").union(edges.select("dst")).distinct().count()
    trust = spread(edges, named.select("host", (F.col("allowed") / F.col("pages")).alias("seed")), scratch, "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(back, named.select("host", (F.col("blocked") / F.col("pages")).alias("seed")), scratch, "distrust")
    trusted, distrusted = trust.select("host", F.col("score").alias("trust")), distrust.select("host", F.col("score").alias("distrust"), "arrived")
    scores = named.select("host", (2 * F.col("blocked") > F.col("pages")).alias("mostly")).join(trusted, "host", "left").join(distrusted, "host", "left")
    scaled = scores.select("host", "mostly", *[(F.coalesce(c, F.lit(0.0)) * hosts).alias(c) for c in ("trust", "distrust", "arrived")])
    against = F.when(F.col("mostly"), F.col("distrust")).otherwise(F.col("arrived"))
    scaled = scratch.table(scaled.select("host", "trust", "distrust", ((against > LEAST) & (against > F.col("trust") * FACTOR)).alias("bad")), "scores")
    out = small_join(judged, scaled, "host")
    bad = F.coalesce("bad", F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
