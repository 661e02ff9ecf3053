"""URL filter by propagation over the graph of hosts, in DataFrame operations only.

Rules judge what they fit. Every other page is judged by its host: trust flows from hosts
with allowed pages along links, distrust flows from hosts with blocked pages against them (who
links to bad hosts is suspect), both as personalised PageRank. Both are parts of the same total, the pages
that rules judge, so they can be compared. A host is blocked if its distrust outweighs its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.session import durable_copy

#: (action, host and path); the path starts at the slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
TOLERANCE = 1e-3  # largest change of a rank from one table to the next, relative to the rank, at which ranks are taken as settled
MOST_ROUNDS = 400
KEEP_EVERY = 4  # rounds between tables that cut the lineage
CLOSE = 1e-9  # differences of trust and distrust below this share of their sum are none
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty for null or a url without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of equal ones the first) and its action; null if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        on_host, slash, below = text.partition("/")
        fits = ((host == on_host) | F.endswith(host, F.lit("." + on_host))) & F.startswith(path, F.lit(slash + below))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(action)
    return rule, action


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight`` between different hosts: links in the html, and each host with the domain above it.

    Links within a host say nothing about another and are left out. A host and its parent domain
    (down to two labels) vouch for each other with weight 1; parents need no page of their own.
    """
    host, _ = host_and_path("url")
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).filter("src != '' and dst != '' and src != dst")
    links = links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))

    hosts = pages.select(host.alias("host")).filter("host != ''").distinct()
    labels = F.split("host", r"\.")
    depth = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    name = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    chain = hosts.filter(F.size(labels) > 2).select(F.explode(F.transform(depth, lambda i: F.struct(name(i).alias("src"), name(i + 1).alias("dst")))).alias("e"))
    up = chain.select("e.*").filter(F.contains("dst", F.lit("."))).distinct()
    kin = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return links.unionByName(kin).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, trust, distrust``: personalised PageRank of both kinds over all hosts reached from a seed.

    Rounds go on until in ``KEEP_EVERY`` of them no host is new and no rank changes by more than ``tolerance`` of itself, so hosts far from a
    seed and hosts of small rank count as others do. What each round adds is ``damping`` of what the one
    before it added, so that comes; ranks are not rounded.

    ``seeds``: ``host, trusted, blocked`` (numbers of pages). What a host without out-links holds
    returns to nobody. A host with very many links is summed up before each shuffle.
    """
    forward = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight")
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    both = forward.unionByName(backward)
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    steps = durable_copy(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "steps")

    stacked = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trusted", F.lit("distrust"), "blocked")).alias("kind", "n")).filter("n > 0")
    total = stacked.agg(F.sum("n").alias("total"))
    start = durable_copy(stacked.select("kind", "host", (F.col("n") / total.scalar()).alias("seed")), "seeds")
    home = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    rank = start.select("kind", "host", F.col("seed").alias("rank"))
    for _ in range(0, MOST_ROUNDS, KEEP_EVERY):
        before = rank
        for _ in range(KEEP_EVERY):  # each round reads the one before it once, so the plan grows with the rounds only
            moved = rank.withColumnRenamed("host", "src").join(steps, ["kind", "src"])
            moved = moved.select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
            rank = moved.unionByName(home).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = durable_copy(rank, "rank")
        both = rank.withColumn("was", F.lit(0.0)).unionByName(before.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("was")))
        both = both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was"))
        if both.filter(F.abs(F.col("rank") - F.col("was")) > tolerance * F.greatest("rank", "was")).isEmpty():
            break
    else:
        raise RuntimeError(f"ranks did not settle in {MOST_ROUNDS} rounds")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.0, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages`` (``page_id, url, html``).

    A page that a rule fits gets that rule's verdict. Another is blocked if its host's trust less
    distrust, as a share of their sum, is under ``threshold``; a host that nothing reaches, or an empty one, has 0 of both.
    Null html has no links. Repeated rows count as so many pages and each get a row.
    """
    host, path = host_and_path("url")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumns({"rule": rule, "action": action})
    count = lambda verdict: F.sum((F.col("action") == verdict).cast("long"))
    seeds = urls.filter("action is not null and host != ''").groupBy("host").agg(count("allow").alias("trusted"), count("block").alias("blocked"))
    ranks = durable_copy(propagate(host_edges(pages), seeds, damping, tolerance), "hosts")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    found = urls.join(ranks, "host", "left").select("page_id", "host", "path", "rule", "action", zero("trust"), zero("distrust"))
    share = F.coalesce(F.try_divide(F.col("trust") - F.col("distrust"), F.col("trust") + F.col("distrust")), F.lit(0.0))
    by_host = F.when(share < threshold - CLOSE, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("action", by_host).alias("verdict"), "trust", "distrust")
