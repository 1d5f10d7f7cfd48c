"""Scoring, seeding, edge weighting and personalised PageRank, set-at-a-time over a table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.scores import min_max, truncated_min_max
from corpusloom.operators.knn import all_normal, best_normal, products
from corpusloom.session import Scratch, partitions, small

#: Edges of a source that one task takes at a time; those of larger ones are dealt in pieces.
PIECE = 100_000


def scored(queries: DataFrame, items: DataFrame, key: str, *carried: str) -> DataFrame:
    """queries(query, qv) x items(key, v) -> raw products; the stated query set meets all items, in blocks."""
    raw = products(queries.select("query", F.col("qv").alias("v")), items.select(F.col(key).alias("item"), "v"))
    raw = raw.select("query", F.col("item").alias(key), F.col("score").alias("raw"))
    return raw.join(items.select(key, *carried), key) if carried else raw


def scored_normal(queries: DataFrame, items: DataFrame, key: str, *carried: str) -> DataFrame:
    """As scored, with score: raw brought to 0..1 within a query."""
    both = all_normal(queries.select("query", F.col("qv").alias("v")), items.select(F.col(key).alias("item"), "v"))
    both = both.withColumnRenamed("item", key)
    return both.join(items.select(key, *carried), key) if carried else both


def best_scored(queries: DataFrame, items: DataFrame, key: str, k: int, *carried: str) -> DataFrame:
    """(query, key, raw, score, rank, carried): the k best of scored_normal, without a row for every pair."""
    top = best_normal(queries.select("query", F.col("qv").alias("v")), items.select(F.col(key).alias("item"), "v"), k)
    top = top.withColumnRenamed("item", key)
    return top.join(items.select(key, *carried), key) if carried else top


def ranked(scores: DataFrame, by: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc(by), key)
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def relevance(mentioned: DataFrame, passages: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Per query and entity the largest raw passage score; 0 for those of entities(entity) that no passage mentions."""
    found = mentioned.join(passages, "chunk").groupBy("query", "entity").agg(F.max("raw").alias("relevance"))
    if entities is None:
        return found
    lone = entities.select("entity").join(mentioned, "entity", "left_anti")
    # a stated query set meets the entities without a passage
    asked = passages.select("query").distinct()
    return found.unionByName(lone.join(F.broadcast(asked), F.col("query").isNotNull()).select("query", "entity", F.lit(0.0).alias("relevance")))


def phrase_weights(picked: DataFrame, mentioned: DataFrame, counted: bool = False) -> DataFrame:
    """picked(query, s, o, score) -> per query and entity the mean of score over the entity's number of chunks; counted tables hold (entity, chunks)."""
    counts = mentioned if counted else mentioned.groupBy("entity").agg(F.count("*").alias("chunks"))
    ends = picked.select("query", "score", F.explode(F.array("s", "o")).alias("entity"))
    return ends.join(counts, "entity").groupBy("query", "entity").agg(F.avg(F.col("score") / F.col("chunks")).alias("weight"))


def seeds(weights: DataFrame, nodes: DataFrame, k: int | None) -> DataFrame:
    """weights(query, entity, weight) of entities among nodes(node): the k heaviest of each query, all without k."""
    known = weights.join(nodes.select(F.col("node").alias("entity")), "entity", "left_semi")
    return ranked(known.withColumn("_by", F.round("weight", 9)), "_by", "entity", k).drop("_by", "rank") if k else known


def edge_score(rel: Column, delta: Column, prior: Column | None = None, base: float = 0.0, by_rel: float = 1.0, by_prior: float = 1.0, by_div: float = 1.0, floor: float = 1e-6) -> Column:
    score = F.lit(base) + by_rel * rel - by_div * F.abs(delta)
    return F.greatest(F.lit(floor), score if prior is None else score + by_prior * prior)


def directed_weights(edges: DataFrame, div: DataFrame, rel: DataFrame, down: float = 0.9, up: float = 0.1, loops: bool = True, directions: bool = True, prior: bool = False, **terms: float) -> DataFrame:
    """Entity edges (src, dst[, prior_norm]) per query: scores shared out within the downward and the upward budget of each source.

    A source without upward edges gives its whole budget down; one without downward edges keeps the
    downward budget on itself, or, without loops, gives its whole budget up. Without directions the weights
    are the scores. Entities that rel lacks have relevance 0.
    """
    e = edges.join(div.select(F.col("entity").alias("src"), F.col("norm").alias("du")), "src").join(div.select(F.col("entity").alias("dst"), F.col("norm").alias("dv")), "dst")
    e = e.join(rel.select("query", F.col("entity").alias("dst"), F.col("norm").alias("rv")), "dst")
    e = e.withColumn("delta", F.round(F.col("dv") - F.col("du"), 9)).withColumn("up", F.col("delta") > 0)
    e = e.withColumn("score", edge_score(F.col("rv"), F.col("delta"), F.col("prior_norm") if prior else None, **terms))
    if not directions:
        return e.select("query", "src", "dst", F.col("score").alias("weight"))
    total = lambda want: F.sum(F.when(F.col("up") == want, F.col("score")))
    sources = e.groupBy("query", "src").agg(total(True).alias("t_up"), total(False).alias("t_down"))
    e = e.join(sources, ["query", "src"])
    to_up = F.when(F.col("t_down").isNull() & F.lit(not loops), F.lit(down + up)).otherwise(F.lit(up))
    to_down = F.when(F.col("t_up").isNull(), F.lit(down + up)).otherwise(F.lit(down))
    weight = F.when(F.col("up"), to_up * F.col("score") / F.col("t_up")).otherwise(to_down * F.col("score") / F.col("t_down"))
    out = e.select("query", "src", "dst", weight.alias("weight"))
    own = sources.where("t_down is null").select("query", "src", F.col("src").alias("dst"), F.lit(down).alias("weight"))
    return out.unionByName(own) if loops else out


def sane(r: Column) -> Column:
    """A reset value; NaN, null and negative ones are 0."""
    return F.when(F.isnan(r) | r.isNull() | (r < 0), 0.0).otherwise(r)


@dataclass(frozen=True)
class Factors:
    """The directed weights of all queries in parts: a query's weight of an edge is made where its rank passes.

    edges(src, dst, up, fixed): once for all queries, fixed being what does not depend on one.
    relevance(query, node, rv). sources(query, src, t_up, t_down): sums of a source's scores by direction.
    """

    edges: DataFrame
    relevance: DataFrame
    sources: DataFrame
    by_rel: float
    floor: float
    down: float
    up: float
    loops: bool
    directions: bool

    def score(self) -> Column:
        return F.greatest(F.lit(self.floor), self.by_rel * F.col("rv") + F.col("fixed"))

    def scales(self, common: DataFrame) -> DataFrame:
        """(query, src, common, a_common, a_up, a_down, a_loop): shares are these times weight or score. common(src, common): the sum of a source's other weights."""
        s = self.sources.join(common.select("src", "common"), "src", "left").withColumn("common", F.coalesce("common", F.lit(0.0)))
        if not self.directions:
            total = F.col("common") + F.coalesce("t_up", F.lit(0.0)) + F.coalesce("t_down", F.lit(0.0))
            return s.select("query", "src", (1 / total).alias("a_common"), (1 / total).alias("a_up"), (1 / total).alias("a_down"), F.lit(0.0).alias("a_loop"))
        no_up, no_down = F.col("t_up").isNull(), F.col("t_down").isNull()
        to_up = F.when(no_up, 0.0).when(no_down & F.lit(not self.loops), self.down + self.up).otherwise(self.up)
        to_down = F.when(no_down, 0.0).when(no_up, self.down + self.up).otherwise(self.down)
        loop = F.when(no_down & F.lit(self.loops), self.down).otherwise(0.0)
        total = F.col("common") + to_up + to_down + loop
        return s.select("query", "src", (1 / total).alias("a_common"), (to_up / F.col("t_up") / total).alias("a_up"), (to_down / F.col("t_down") / total).alias("a_down"), (loop / total).alias("a_loop"))


def factors(spark: SparkSession, edges: DataFrame, div: DataFrame, rel: DataFrame, down: float = 0.9, up: float = 0.1, loops: bool = True, directions: bool = True, prior: bool = False, base: float = 0.0, by_rel: float = 1.0, by_prior: float = 1.0, by_div: float = 1.0, floor: float = 1e-6) -> Factors:
    """What directed_weights makes of the same arguments, without a row for each query and edge."""
    scratch = Scratch(spark)
    e = edges.join(div.select(F.col("entity").alias("src"), F.col("norm").alias("du")), "src").join(div.select(F.col("entity").alias("dst"), F.col("norm").alias("dv")), "dst")
    delta = F.round(F.col("dv") - F.col("du"), 9)
    fixed = F.lit(base) - by_div * F.abs(delta) + (by_prior * F.col("prior_norm") if prior else F.lit(0.0))
    e = scratch.save(e.select("src", "dst", (delta > 0).alias("up"), fixed.alias("fixed")), "edges")
    rel = scratch.save(rel.select("query", F.col("entity").alias("node"), F.col("norm").alias("rv")), "relevance")
    made = Factors(e, rel, rel, by_rel, floor, down, up, loops, directions)
    scored = e.join(rel.withColumnRenamed("node", "dst"), "dst").withColumn("score", made.score())
    total = lambda want: F.sum(F.when(F.col("up") == want, F.col("score")))
    sources = scratch.save(scored.groupBy("query", "src").agg(total(True).alias("t_up"), total(False).alias("t_down")), "sources")
    return Factors(e, rel, sources, by_rel, floor, down, up, loops, directions)


def dealt(scratch: Scratch, edges: DataFrame, name: str, to: str = "dst") -> tuple[DataFrame, DataFrame | None]:
    """edges(src, ...) in buckets by source, the edges of a hub in several; and hubs(src, lots), if there are any."""
    degrees = scratch.save(edges.groupBy("src").agg(F.count("*").alias("n")), f"{name}-degrees")
    hubs = scratch.save(degrees.where(F.col("n") > PIECE).select("src", F.ceil(F.col("n") / PIECE).cast("int").alias("lots")), f"{name}-hubs")
    n_hubs, n = hubs.count(), degrees.agg(F.sum("n")).first()[0] or 0
    lot = F.lit(0)
    if n_hubs:
        edges = edges.join(small(hubs, n_hubs), "src", "left")
        lot = F.pmod(F.xxhash64(to), F.coalesce("lots", F.lit(1))).cast("int")
    rows = edges.withColumn("lot", lot).drop("lots")
    return scratch.bucketed(rows, name, partitions(edges.sparkSession, n), "src", "lot"), small(hubs, n_hubs) if n_hubs else None


def along(rows: DataFrame, kind: int, edges: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """rows(src, kind, ...): those of the kind with their edges, in as many pieces as a source's edges lie in; all others as they are."""
    pieces = F.array(F.lit(0))
    if hubs is not None:
        rows = rows.join(hubs, "src", "left")
        pieces = F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1)
    lots = F.when(F.col("kind") == kind, pieces).otherwise(F.array(F.lit(-1)))
    return rows.withColumn("lot", F.explode(lots)).drop("lots").join(edges, ["src", "lot"], "left").drop("lot")


def pagerank(spark: SparkSession, edges: DataFrame, reset: DataFrame, damping: float = 0.5, rounds: int = 64, cut: int = 4, keyed: DataFrame | None = None, own: Factors | None = None, least: float = 1e-9, whole: bool = False) -> DataFrame:
    """edges(src, dst, weight), reset(query, node, r) -> (query, node, rank, left): personalised PageRank by pushing residuals.

    Each round every node with a residual above least settles it and passes the damped part on; all others wait.
    Rounds end when no residual is above least, or after rounds of them. What is left of a query's residuals, the
    sum of left, bounds the sum of its ranks' errors, and each rank is too small by at most that. Nodes without an
    edge out send their rank back to the reset, which comes to the same as scaling all ranks of the query at the
    end. keyed(query, src, dst, weight) or own are further edges, which hold for one query each. With whole all of a
    node's residual counts as its rank, as after so many rounds of power iteration.
    """
    scratch = Scratch(spark)
    good = lambda df: df.where("weight > 0 and not isnan(weight)")
    edges = scratch.save(good(edges).select("src", "dst", "weight"), "edges")
    common = scratch.save(edges.groupBy("src").agg(F.sum("weight").alias("common")), "common")
    shares, hubs = dealt(scratch, edges.join(common, "src").select("src", "dst", "weight", (F.col("weight") / F.col("common")).alias("share")), "shares")
    scales = None
    if keyed is not None:
        keyed = scratch.save(good(keyed).select("query", "src", "dst", "weight"), "keyed")
        total = F.col("own") + F.coalesce("common", F.lit(0.0))
        sums = scratch.save(keyed.groupBy("query", "src").agg(F.sum("weight").alias("own")).join(common, "src", "left").select("query", "src", (1 / total).alias("a_common")), "totals")
        own_shares = scratch.save(keyed.join(sums, ["query", "src"]).select("query", "src", F.lit(2).alias("kind"), F.col("dst").alias("own_dst"), (F.col("weight") * F.col("a_common")).alias("own_share")), "own-shares")
        scales = sums
    elif own is not None:
        scales = scratch.save(own.scales(common), "scales")
        own_edges, own_hubs = dealt(scratch, own.edges.withColumnRenamed("dst", "own_dst"), "own-edges", "own_dst")
    reset = reset.select("query", "node", sane(F.col("r")).alias("r")).where("r > 0").groupBy("query", "node").agg(F.sum("r").alias("r"))
    reset = scratch.save(reset, "reset")
    totals = reset.groupBy("query").agg(F.sum("r").alias("_all"))
    carried = [c for c in ("a_common", "a_up", "a_down", "a_loop") if scales is not None and c in scales.columns]
    start = reset.join(totals, "query").select("query", "node", F.lit(0.0).alias("p"), (F.col("r") / F.col("_all")).alias("r"))
    none = [F.lit(None).cast("double").alias(c) for c in carried]
    if carried:
        start = start.select("*", *none).unionByName(scales.join(start.select("query").distinct(), "query", "left_semi").select("query", F.col("src").alias("node"), F.lit(0.0).alias("p"), F.lit(0.0).alias("r"), *carried))
    gather = lambda df: df.groupBy("query", "node").agg(F.sum("p").alias("p"), F.sum("r").alias("r"), *[F.max(c).alias(c) for c in carried])
    state = scratch.save(gather(start) if carried else start, "state-0")

    def step(state: DataFrame) -> DataFrame:
        """One round. Each node is read once: as the row that stays, and as rows (kinds 1 and 2) that go along its edges."""
        ready, r = F.col("r") > least, F.col("r")
        looped = damping * r * F.coalesce("a_loop", F.lit(0.0)) if own is not None else F.lit(0.0)
        leaves = ready & (F.col("a_up").isNotNull() | F.col("a_down").isNotNull()) if own is not None else ready
        row = lambda kind, p, r: F.struct(F.lit(kind).alias("kind"), p.alias("p"), r.alias("r"))
        stay = row(0, F.when(ready, F.col("p") + (1 - damping) * r).otherwise(F.col("p")), F.when(ready, looped).otherwise(r))
        ways = [stay, row(1, F.lit(0.0), F.when(ready, damping * r)), row(2, F.lit(0.0), F.when(leaves, damping * r))]
        ways = F.filter(F.array(*ways[: 3 if carried else 2]), lambda w: w["r"].isNotNull())
        rows = state.select("query", F.col("node").alias("src"), *carried, F.explode(ways).alias("w")).select("query", "src", *carried, "w.*")
        rows = along(rows, 1, shares, hubs)
        stays, goes_own = F.col("kind") == 0, F.col("kind") == 2
        share = F.coalesce(F.col("weight") * F.col("a_common"), F.col("share")) if carried else F.col("share")
        to, part = F.col("dst"), F.col("r") * share
        if keyed is not None:
            rows = rows.join(own_shares, ["query", "src", "kind"], "left")
            to, part = F.coalesce("own_dst", "dst"), F.when(goes_own, F.col("r") * F.col("own_share")).otherwise(part)
        elif own is not None:
            rows = along(rows, 2, own_edges, own_hubs).withColumn("node", F.when(stays, F.col("src")).otherwise(F.coalesce("own_dst", "dst")))
            rows = rows.join(own.relevance, ["query", "node"], "left")
            to, part = F.col("node"), F.when(goes_own, F.col("r") * F.when(F.col("up"), F.col("a_up")).otherwise(F.col("a_down")) * own.score()).otherwise(part)
        kept = [F.when(stays, F.col(c)).alias(c) for c in carried]
        moved = rows.select("query", F.when(stays, F.col("src")).otherwise(to).alias("node"), "p", F.when(stays, F.col("r")).otherwise(part).alias("r"), *kept)
        return gather(moved.where("node is not null and r is not null"))

    turn = 0
    while turn < rounds and not state.where(F.col("r") > least).isEmpty():
        begun, until = turn, min(turn + cut, rounds)
        for turn in range(begun + 1, until + 1):
            state = step(state)
        state = scratch.save(state, f"state-{turn}")
        scratch.drop(f"state-{begun}")
    out = state.where("p > 0 or r > 0").select("query", "node", (F.col("p") + (1 if whole else 1 - damping) * F.col("r")).alias("rank"), (damping * F.col("r")).alias("left"))
    # queries with rank at a node that has no edge out for them have lost some of it
    stuck = state.where("p > 0" + (" and a_common is null" if carried else "")).join(common.select(F.col("src").alias("node")), "node", "left_anti").select("query").distinct()
    stuck = scratch.save(stuck, "stuck")
    if not stuck.isEmpty():
        sums = out.join(stuck, "query", "left_semi").groupBy("query").agg(F.sum("rank").alias("_all"))
        out = out.join(sums, "query", "left").select("query", "node", (F.col("rank") / F.coalesce("_all", F.lit(1.0))).alias("rank"), "left")
    return out


def with_fallback(found: DataFrame, dense: DataFrame, picked: DataFrame) -> DataFrame:
    """Rankings of the queries with a picked fact, and dense rankings of all others."""
    with_facts = picked.select("query").distinct()
    return found.join(with_facts, "query", "left_semi").unionByName(dense.join(with_facts, "query", "left_anti"))


__all__ = ["Factors", "best_scored", "directed_weights", "edge_score", "factors", "min_max", "pagerank", "phrase_weights", "ranked", "relevance", "sane", "scored", "scored_normal", "seeds", "truncated_min_max", "with_fallback"]
