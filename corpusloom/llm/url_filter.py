"""URL filters: host and path rules, else trust and distrust spread over the host link graph.

Trust is personalised PageRank from hosts most of whose pages a rule allows; distrust is the same over
reversed edges from hosts most of whose pages a rule blocks. A host is blocked where its distrust
exceeds its trust, and its distrust times the number of distrusted seeds a floor: in those units every
seed starts with 1, however many hosts there are.

Defined results: null urls and urls without :// have an empty host and path, match no rule and are
allowed; null html has no link; null ids and repeated rows give one row each; an empty table gives an
empty result; columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import Scratch, ascii_lower, salted_join

#: (host, path, verdict); a rule's name is host and path.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
LINK = r"""(?i)\bhref\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(after_scheme(url), r"(?s)^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = 0.85, rounds: int = 30, tolerance: float = 1e-9) -> DataFrame:
    """edges(kind, src, dst, share), seeds(kind, host, seed) -> (kind, host, rank), one personalised PageRank per kind.

    Shares of a source add up to 1; the mass of hosts without an edge goes back to the seeds. Ranks are
    written between rounds; rounds end early once they move by less than tolerance.
    """
    rank = scratch.save(seeds.withColumnRenamed("seed", "rank"), "rank-0")
    for turn in range(1, rounds + 1):
        sent = rank.withColumnRenamed("host", "src").join(edges, ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("got"))
        sent = scratch.save(sent, f"sent-{turn}")
        back = seeds.select("kind").distinct().join(sent.groupBy("kind").agg(F.sum("got").alias("kept")), "kind", "left")
        home = seeds.join(back, "kind").select("kind", "host", (F.col("seed") * (1 - F.coalesce("kept", F.lit(0.0)))).alias("got"))
        new = scratch.save(sent.unionByName(home).groupBy("kind", "host").agg(F.sum("got").alias("rank")), f"rank-{turn}")
        old = rank.withColumnRenamed("rank", "old")
        moved = new.join(old, ["kind", "host"], "full").agg(F.coalesce(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))), F.lit(0.0))).first()[0]
        scratch.drop(f"rank-{turn - 1}", f"sent-{turn}")
        rank = new
        if moved < tolerance:
            break
    return rank


def judge(spark: SparkSession, pages: DataFrame, scratch: Scratch, rules: tuple = RULES, floor: float = 1e-6) -> DataFrame:
    """pages(page_id, url, html) -> page_id, host, path, rule, verdict."""
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = scratch.save(seen.withColumn("rule", rule).withColumn("ruled", ruled), "judged")
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), host_of))).alias("dst"))
    counts = scratch.save(links.where("src != '' and dst != '' and src != dst").groupBy("src", "dst").count(), "links")
    both = counts.select(F.lit("trust").alias("kind"), "src", "dst", "count").unionByName(counts.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "count"))
    out = both.groupBy("kind", "src").agg(F.sum("count").alias("total"))
    edges = scratch.save(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("count") / F.col("total")).alias("share")), "edges")

    hosts = seen.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    hosts = scratch.save(hosts, "hosts")
    chosen = hosts.where("host != ''").select("host", F.when(F.expr("2 * allowed > pages"), F.lit("trust")).when(F.expr("2 * blocked > pages"), F.lit("distrust")).alias("kind")).where("kind is not null")
    sizes = chosen.groupBy("kind").count()
    seeds = scratch.save(chosen.join(sizes, "kind").select("kind", "host", (1 / F.col("count")).alias("seed")), "seeds")
    rank = propagate(edges, seeds, scratch)
    rank = rank.join(sizes.withColumnRenamed("count", "seeds"), "kind")
    score = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"), F.max(F.when(F.col("kind") == "distrust", F.col("seeds"))).alias("seeds"))
    bad = (F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0))) & (F.coalesce(F.col("distrust") * F.col("seeds"), F.lit(0.0)) > floor)
    hosts = hosts.join(score, "host", "left").select("host", "pages", F.when(bad, "block").otherwise("allow").alias("spread"))
    found = salted_join(seen, hosts, "host", "pages", F.col("page_id"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", "spread").alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark))
