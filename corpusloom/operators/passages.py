"""Personalised PageRank of the best passages, without a row for every query and passage.

Passages have edges to entities only, and their share of the reset is linear in the query's vector. So passages
are folded into the entities they mention: what they pass on is an entity's sum of their vectors, and a way from
entity to passage to entity is one edge of a folded graph. A group of queries iterates on entities alone; then all
passages stream by once, get their rank from entities and product, and only a query's best are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.knn import CELLS, Best, Extremes, folded, matrix
from corpusloom.operators.retrieval import sane
from corpusloom.session import Scratch, small

#: Edges of both kinds between entities that are sent to the tasks, and numbers of the entities' sums of vectors.
HELD = 4_000_000
#: Ranks of entities that a task holds: queries of its group times entities.
RANKS = 1 << 24


class Entities:
    """The graph of entities, and what passages give it."""

    def __init__(self, n: int, direct: np.ndarray, ways: np.ndarray, sums: np.ndarray, counts: np.ndarray, degrees: np.ndarray):
        """direct, ways: (dst, src, weight), along an edge and by way of a passage; sums, counts: what passages send of their vectors and of 1; degrees: passages."""
        src, dst = (np.concatenate([x[c] for x in (direct, ways)]) for c in ("src", "dst"))
        self.n, self.n_direct, self.sums, self.counts = n, len(direct), sums, counts
        self.out = degrees + np.bincount(direct["src"], direct["weight"], n)
        # states of this round and of the one before lie one after the other: a way by a passage takes two rounds
        self.src, self.dst = np.where(np.arange(len(src)) < len(direct), src, src + n).astype(np.int32), dst.astype(np.int32)
        self.share = np.concatenate([direct["weight"], ways["weight"]]) / self.out[src]

    def iterated(self, seeds: np.ndarray, given: np.ndarray, damping: float, rounds: int) -> np.ndarray:
        """Ranks after rounds; given is what passages send in the first of them."""
        if not rounds:
            return seeds
        share = np.where(np.arange(len(self.share)) < self.n_direct, damping, damping**2) * self.share
        first = share[: self.n_direct]
        before, x = seeds, np.bincount(self.dst[: self.n_direct], seeds[self.src[: self.n_direct]] * first, self.n) + damping * given + (1 - damping) * seeds
        steady = damping * (1 - damping) * given + (1 - damping) * seeds
        for _ in range(rounds - 1):
            before, x = x, np.bincount(self.dst, np.concatenate([x, before])[self.src] * share, self.n) + steady
        return x


class Group:
    """The queries of a group: their ranks of entities, then their best passages."""

    def __init__(self, entities: Entities, asked: pd.DataFrame, weight: float, total: tuple[np.ndarray, float], best: int, damping: float, rounds: int):
        self.v, self.low, span = matrix(asked["v"]), asked["low"].to_numpy()[:, None], (asked["high"] - asked["low"]).to_numpy()[:, None]
        self.same, self.span = span == 0, np.where(span == 0, 1.0, span)
        given = weight * self.scaled(self.v @ entities.sums.T, entities.counts)
        all_of = weight * self.scaled(self.v @ total[0][:, None], total[1])[:, 0]
        # passed on by an entity to each of its passages; entities first, so that those of a passage are gathered by row
        self.passed = np.empty((entities.n, len(asked)))
        for k, (at, r) in enumerate(zip(asked["ends"], asked["parts"])):
            seeds = np.zeros(entities.n)
            if at is not None:
                np.add.at(seeds, np.asarray(at, int), np.asarray(r, float))
            everything = all_of[k] = all_of[k] + seeds.sum()
            self.passed[:, k] = 0.0 if everything <= 0 else damping * entities.iterated(seeds / everything, given[k] / everything, damping, rounds - 1) / entities.out
        self.own = np.divide((1 - damping) * weight, all_of, out=np.zeros_like(all_of), where=all_of > 0)[:, None]
        self.best = Best(asked["query"].to_numpy(), best)

    def scaled(self, raw: np.ndarray, n: np.ndarray | float) -> np.ndarray:
        """Sums of n products, brought to 0..1 each."""
        return np.where(self.same, n, np.maximum(0.0, (raw - self.low * n) / self.span))

    def add(self, passages: pd.DataFrame) -> None:
        step = max(1, CELLS // len(self.v))
        for a in range(0, len(passages), step):
            part = passages.iloc[a : a + step]
            sizes = part["ends"].map(len).to_numpy()
            passed = np.add.reduceat(self.passed[np.concatenate(part["ends"].to_list()).astype(int)], np.cumsum(sizes) - sizes, axis=0).T
            known = part["v"].notna().to_numpy()
            if known.any():
                passed[:, known] += self.own * self.scaled(self.v @ matrix(part["v"][known]).T, 1.0)
            for _ in self.best.add(part["item"].to_numpy(), np.ascontiguousarray(passed)):
                pass


def best_passages(spark: SparkSession, edges: DataFrame, mentioned: DataFrame, seeds: DataFrame, queries: DataFrame, items: DataFrame, weight: float, best: int, damping: float = 0.5, rounds: int = 24, held: int | None = None, ranks: int | None = None) -> DataFrame | None:
    """(query, node, rank): each query's best passages by rank after rounds, equal to 9 places by node, or None.

    edges(src, dst, weight) between entities, mentioned(entity, chunk) with edges of weight 1 both ways, and the reset:
    seeds(query, node, r) among entities, and weight times the product of queries(query, qv) and items(chunk, v), brought
    to 0..1 within a query. None for what this does not hold for: entities beyond held, passages without an
    entity, passages or queries given twice, and vectors that are not finite.
    """
    held, ranks, scratch = HELD if held is None else held, RANKS if ranks is None else ranks, Scratch(spark)
    named = scratch.save(mentioned.where("entity is not null and chunk is not null").select("entity", "chunk").distinct(), "named")
    sizes = named.groupBy("chunk").agg(F.count("*").alias("n"))
    asked = queries.where("qv is not null").select("query", F.col("qv").alias("v"))
    passages = items.select(F.col("chunk").alias("item"), "v")
    odd = passages.where("item is null or exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    twice = lambda df, key: df.groupBy(key).count().where("count > 1")
    lone = passages.join(named.select(F.col("chunk").alias("item")), "item", "left_anti")
    if not (odd.isEmpty() and lone.isEmpty() and twice(passages, "item").isEmpty() and twice(asked, "query").isEmpty() and sizes.join(passages.select(F.col("item").alias("chunk")), "chunk", "left_anti").isEmpty()):
        return None
    counts = scratch.save(named.groupBy("entity").agg(F.count("*").cast("double").alias("n")), "counts")
    n, n_passages = counts.count(), passages.count()
    paired = sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    if not n or n > held or paired > max(8 * n_passages, held):
        return None
    # within the bound one task can number them
    ids = scratch.save(counts.withColumn("id", F.row_number().over(Window.orderBy("entity")) - 1), "ids")
    id_of = lambda c, to: small(ids.select(F.col("entity").alias(c), F.col("id").alias(to)), n)
    ends = scratch.save(named.join(id_of("entity", "id"), "entity").groupBy("chunk").agg(F.sort_array(F.collect_list("id")).alias("ends")), "ends")
    # a passage passes an equal part on to each of its entities
    way = F.explode(F.flatten(F.transform("ends", lambda a: F.transform("ends", lambda b: F.struct(a.alias("src"), b.alias("dst"))))))
    ways = ends.select((1.0 / F.size("ends")).alias("part"), way.alias("e")).groupBy("e.src", "e.dst").agg(F.sum("part").alias("weight"))
    direct = edges.where("weight > 0 and not isnan(weight)").join(id_of("src", "_src"), "src").join(id_of("dst", "_dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "weight")
    ways, direct = scratch.save(ways, "ways"), scratch.save(direct, "direct")
    dims = passages.agg(F.max(F.size("v"))).first()[0] or 0
    if ways.count() + direct.count() > held or n * dims > held:
        return None
    known = scratch.save(ends.join(passages.where("v is not null").withColumnRenamed("item", "chunk"), "chunk").select("chunk", "ends", "v"), "passages")
    bounds = folded(asked, passages, Extremes).groupBy("query").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    bounds = scratch.save(bounds, "bounds")
    if not bounds.where("isnan(low) or isnan(high) or isnan(high - low) or abs(high - low) = double('inf')").isEmpty():
        return None

    added = lambda part: vector_to_array(Summarizer.sum(array_to_vector(F.col("v")), part))
    sent = known.select(F.explode("ends").alias("id"), (1.0 / F.size("ends")).alias("part"), "v").groupBy("id").agg(added(F.col("part")).alias("v"), F.sum("part").alias("n")).toPandas()
    sums, counted = np.zeros((n, dims)), np.zeros(n)
    if len(sent):
        sums[sent["id"]], counted[sent["id"]] = matrix(sent["v"]), sent["n"]
    whole = known.agg(added(F.lit(1.0)).alias("v"), F.count("*").alias("n")).first() if len(sent) else None
    total = (np.array(whole["v"]), float(whole["n"])) if whole else (np.zeros(dims), 0.0)
    degrees = np.zeros(n)
    degree = ids.select("id", "n").toPandas()
    degrees[degree["id"]] = degree["n"]
    table = lambda df: df.select("src", "dst", "weight").orderBy("dst", "src").toPandas().to_records(index=False)
    graph = spark.sparkContext.broadcast((Entities(n, table(direct), table(ways), sums, counted, degrees), total))

    begun = seeds.select("query", F.col("node").alias("entity"), sane(F.col("r")).alias("r")).where("r > 0").join(id_of("entity", "id"), "entity").groupBy("query").agg(F.collect_list("id").alias("ends"), F.collect_list("r").alias("parts"))
    begun = scratch.save(asked.join(bounds, "query").join(begun, "query", "left"), "begun")
    n_asked = begun.count()
    groups = min(max(n_asked, 1), max(spark.sparkContext.defaultParallelism, -(-n_asked * n // ranks)))
    kind = queries.schema["query"].dataType
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    left = begun.select(F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), "query", none("string", "item"), "v", "low", "high", "ends", "parts")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    right = ends.join(known.select("chunk", "v"), "chunk", "left").select(every, F.lit(1).alias("kind"), none(kind, "query"), F.col("chunk").alias("item"), "v", none("double", "low"), none("double", "high"), "ends", none("array<double>", "parts"))

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of whole groups, one after the other, each with its queries first."""
        at, waiting, group = None, [], None
        for f in frames:
            where = f["group"].to_numpy()
            cuts = np.flatnonzero(np.diff(where)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(f)]):
                part = f.iloc[a:b]
                if len(part) and where[a] != at:
                    if group is not None:
                        yield from group.best.end()
                    at, waiting, group = where[a], [], None
                first = part["kind"].to_numpy() == 0
                if first.any():
                    waiting.append(part[first])
                if waiting and not first.all():
                    if group is None:
                        group = Group(graph.value[0], pd.concat(waiting, ignore_index=True), weight, graph.value[1], best, damping, rounds)
                    group.add(part[~first])
        if group is not None:
            yield from group.best.end()

    rows = left.unionByName(right).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "kind")
    out = rows.mapInPandas(found, f"query {kind.simpleString()}, item string, {Best.fields}")
    return out.where("score > 0").select("query", F.col("item").alias("node"), F.col("score").alias("rank"))
