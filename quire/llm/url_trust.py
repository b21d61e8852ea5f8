"""URL verdicts: path rules first, then trust and distrust spread over the host graph.

Trust is a personalised PageRank that starts at hosts with allowed pages;
distrust is one over the reversed edges, which starts at hosts with blocked
pages and so reaches the hosts that point to them. A host whose share of
distrust passes a threshold is blocked where no rule speaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import Store, ascii_lower

LINKS = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest fitting (verdict, host, path) rule, else nulls.

    ``urls`` has ``host`` and ``path``. A handful of rules is an expression;
    the longest rule is tested first.
    """
    rule = verdict = None
    for decision, host, path in sorted(rules, key=lambda r: (-len(r[1]), -len(r[2]), r[1], r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return urls.withColumns({"rule": none if rule is None else rule, "rule_verdict": none if verdict is None else verdict})


def host_edges(pages: DataFrame, parent_weight: float) -> DataFrame:
    """(src, dst, weight): links to other hosts, and every (sub)domain with its parent domain both ways.

    ``pages`` has ``host`` and ``html``. Counts are added up before the shuffle.
    """
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINKS), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode(found).alias("url"))
    links = links.select("src", ascii_lower(F.regexp_extract("url", r"//([^/?#]*)", 1)).alias("dst"), F.lit(1.0).alias("weight"))
    labels = F.split("host", r"\.")
    level = F.sequence(F.lit(1), F.size("labels") - 1)
    domain = lambda i: F.array_join(F.slice("labels", i, F.size("labels")), ".")
    steps = F.transform(level, lambda i: F.struct(domain(i).alias("src"), domain(i + 1).alias("dst")))
    hosts = pages.select("host").distinct().select(labels.alias("labels")).filter(F.size("labels") > 2)
    kin = hosts.select(F.explode(F.slice(steps, F.lit(1), F.size("labels") - 2)).alias("step"))
    kin = kin.select("step.*", F.lit(parent_weight).alias("weight")).distinct()
    kin = kin.unionByName(kin.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    edges = links.unionByName(kin).filter("src <> dst and src <> '' and dst <> ''")
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(
    seeds: DataFrame, edges: DataFrame, store: Store, rounds: int, damping: float, cut_every: int = 5
) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, good, bad) and ``edges`` (src, dst, weight).

    Both ranks go through one join a round: the edges carry the direction that
    each applies to. Mass of hosts without outgoing edges is dropped; the
    teleport share returns it to the seeds.
    """
    both = edges.select(F.lit("good").alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit("bad").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    both = both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share"))
    both = store.save(both, "edges")
    start = seeds.select("host", F.expr("stack(2, 'good', good, 'bad', bad) as (kind, mass)")).filter("mass > 0")
    total = start.groupBy("kind").agg(F.sum("mass").alias("total"))
    start = start.join(F.broadcast(total), "kind").select("kind", "host", (F.col("mass") / F.col("total")).alias("start"))
    start = store.save(start, "seeds")
    rank = start.withColumnRenamed("start", "mass")
    for i in range(rounds):
        moved = rank.withColumnRenamed("host", "src").join(both, ["kind", "src"])
        moved = moved.select("kind", F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
        back = start.select("kind", "host", (F.col("start") * (1 - damping)).alias("mass"))
        rank = moved.unionByName(back).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if (i + 1) % cut_every == 0 or i + 1 == rounds:
            rank = store.save(rank, f"rank{i}")
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0))
    return rank.groupBy("host").agg(total("good").alias("trust"), total("bad").alias("distrust"))


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    rounds: int = 15,
    damping: float = 0.85,
    threshold: float = 0.5,
    parent_weight: float = 0.1,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, distrust_share), one row for each row of ``pages``.

    A page without a fitting rule is blocked when its host's share of distrust,
    rounded to 9 digits, is over ``threshold``; a host that neither walk reaches,
    or without a name, has share 0. A null url or html counts as empty.
    """
    store = Store(pages.sparkSession, "url-trust")
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = apply_rules(named, rules)
    seeds = ruled.groupBy("host").agg(
        F.count_if(F.col("rule_verdict") == "allow").cast("double").alias("good"),
        F.count_if(F.col("rule_verdict") == "block").cast("double").alias("bad"),
    ).filter("host <> ''")
    edges = store.save(host_edges(named.select("host", "html"), parent_weight), "links")
    ranks = propagate(seeds, edges, store, rounds, damping)
    share = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9)
    ranks = ranks.filter("trust + distrust > 0").select("host", share.alias("distrust_share"))
    judged = ruled.drop("html").join(ranks, "host", "left").withColumn("distrust_share", F.coalesce("distrust_share", F.lit(0.0)))
    method = F.when(F.col("distrust_share") > threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "distrust_share")
