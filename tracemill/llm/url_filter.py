"""URL filters: written rules first, link-graph propagation for everything they leave open.

Trust starts at hosts with allowed pages and flows along links (personalised PageRank); distrust
starts at hosts with blocked pages and flows against them, to the hosts that link there. Both run on
host edges that are summed before the first step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracemill.llm.scratch import Scratch

# (verdict, host, path) of the given rules. Fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
DAMPING = 0.85
TOLERANCE = 1e-6
# Each step shrinks the sum of all changes by the damping, so that even 10^9 hosts settle in about 220 steps.
# Beyond this number something is wrong, and an error tells so.
MOST_STEPS = 2000
# A host is blocked if its distrust is at least this share of a fully blocked seed's, and above its trust.
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url) -> "F.Column":
    """From the first '://' to '/', '?', '#' or the end, A-Z in lower case; '' without '://'."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url) -> "F.Column":
    """What follows the host, to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rules(host, path, rules) -> tuple["F.Column", "F.Column"]:
    """The longest fitting rule as text (host and path joined), and its verdict. Both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule = F.when(fits, domain + start).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, links)`` between different hosts, from the absolute links in the pages' html.

    ``pages`` has host and html. Links are summed per page partition before the shuffle.
    """
    targets = F.regexp_extract_all(
        "html", F.lit("(?i)\\b(?:href|src)\\s*=\\s*[\"']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\\s>]*)"), F.lit(1))
    links = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(targets).alias("link"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return links.withColumn("dst", host_of(absolute)).where("dst != '' and dst != src").groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("links"))


def _spread(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float) -> DataFrame:
    """``(host, rank)``: rank = (1 - damping) * seed + damping * (ranks of sources, by share of links).

    ``edges``: (src, dst, links); ``seeds``: (host, seed). Hosts without rank have none listed. Steps go
    on until what still can move adds up to TOLERANCE or less for any host; a host without links keeps
    nothing for others.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("all_links"))
    shares = scratch.keep(edges.join(out, "src").select(
        "src", "dst", (F.col("links") / F.col("all_links")).alias("share")), "shares")
    start = seeds.where("seed > 0").select("host", ((1 - damping) * F.col("seed")).alias("base"))
    ranks = scratch.keep(start.select("host", F.col("base").alias("rank")), "ranks")
    if not shares.head(1):
        return ranks
    for _ in range(MOST_STEPS):
        flow = shares.join(ranks, F.col("src") == F.col("host")).groupBy(F.col("dst").alias("host")).agg(
            F.sum(F.col("share") * F.col("rank")).alias("flow"))
        following = scratch.keep(start.join(flow, "host", "full").select("host", (
            F.coalesce("base", F.lit(0.0)) + damping * F.coalesce("flow", F.lit(0.0))).alias("rank")), "ranks")
        moved = following.join(ranks.withColumnRenamed("rank", "before"), "host", "full").agg(F.max(F.abs(
            F.coalesce("rank", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))))).first()[0] or 0.0
        scratch.drop(ranks)
        ranks = following
        # The rest of the series is at most damping / (1 - damping) times the last change.
        if moved * damping <= TOLERANCE * (1 - damping):
            return ranks
    raise RuntimeError(f"ranks still move after {MOST_STEPS} steps")


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING,
          threshold: float = THRESHOLD) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)``, one row per row of ``pages``.

    A rule decides its pages. Other pages take their host's verdict: block if the host's distrust,
    relative to that of a fully blocked host without links, reaches ``threshold`` and exceeds its
    trust, else allow. A host seeds trust (distrust) with the share of its pages that rules allow
    (block). Null urls and urls without '://' have an empty host, which no rule fits and no link
    reaches: allow. Null or empty html has no links. Repeated rows are judged alike and count again in
    their host's shares; ties are allowed; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = _rules(F.col("host"), F.col("path"), rules)
    ruled = scratch.keep(parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule")), "ruled")
    seeds = scratch.keep(ruled.where("host != ''").groupBy("host").agg(
        F.avg((F.coalesce("by_rule", F.lit("")) == "allow").cast("double")).alias("good"),
        F.avg((F.coalesce("by_rule", F.lit("")) == "block").cast("double")).alias("bad")), "seeds")
    edges = scratch.keep(host_edges(parsed), "edges")
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    trust = _spread(edges, seeds.select("host", F.col("good").alias("seed")), scratch, damping)
    distrust = _spread(against, seeds.select("host", F.col("bad").alias("seed")), scratch, damping)
    scale = F.lit(1 - damping)
    hosts = trust.withColumnRenamed("rank", "trust").join(
        distrust.withColumnRenamed("rank", "distrust"), "host", "full").select(
        "host", (F.coalesce("trust", F.lit(0.0)) / scale).alias("trust"),
        (F.coalesce("distrust", F.lit(0.0)) / scale).alias("distrust"))
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return ruled.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
