"""Approximate nearest neighbours: an NN-descent graph and greedy search in it.

Equal vectors are one node, named by the least of their ids. A forest of trees gives each node a few first
neighbours out of small leaves: planes between two vectors of a cell, set at the cell's median, fitted on
a bounded sample (SAMPLE vectors), and below that planes through the cells' centres; every vector is in a
leaf of every tree, and leaves are of one size at every size of table. Rounds of NN-descent then compare, at every node,
the nodes that list it or that it lists, where one of the two is new there, and keep for each the best,
until a round replaces less than SETTLED of all list entries. A query starts from its own node's
neighbours and expands the best nodes of its beam, many at a time, until every node of the beam is
expanded. The beam's best nodes are scored again in double precision on the original vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do null ids and vectors of another length than most; an id with several vectors stands for the
least of them, so repeated rows count once; ties go to the smaller id; an empty table gives an empty
result; columns that are not named are ignored. The neighbour lists and beams are bounded, which is
what makes the search approximate; every node is in the graph.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from corpusloom.llm.streams import whole_groups
from corpusloom.session import Scratch, partitions, salted_join, small

NEIGHBOURS, REVERSED, TREES, LEAF, FIRST, SETTLED = 32, 16, 6, 64, 8, 0.001
#: Vectors that the trees are fitted on, whatever the input's size, and the fewest of them that a cell is fitted on.
SAMPLE, FITTED = 16_384, 16
BEAM, EXPANDED = 256, 48
#: Nodes up to which half-float codes, and floats, of all nodes may be broadcast (about 30 MB).
CODES, VECTORS = 200_000, 100_000
EDGES = "node long, nbr long, sim float"


def floats(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1)


def codes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float16).reshape(len(column), -1).astype(np.float32) if len(column) else np.zeros((0, 1), np.float32)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (norm(a) * norm(b))


def usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): one finite non-zero vector of doubles per id."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double") + F.lit(0.0))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return rows.where(~F.exists("v", bad)).where(F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def merged(rows: DataFrame, n: int, keep: int) -> DataFrame:
    """Edges (with fresh) -> the keep most similar neighbours of each node; one is fresh unless any of its rows is not.

    low is what a neighbour must exceed to enter the node's list; head marks one row of each node.
    """

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, _ in whole_groups(frames, "node"):
            node, nbr, sim, fresh = (f[c].to_numpy() for c in ("node", "nbr", "sim", "fresh"))
            order = np.lexsort((-sim, nbr, node))
            node, nbr, sim, fresh = node[order], nbr[order], sim[order], fresh[order]
            new = np.ones(len(node), bool)
            new[1:] = (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])
            node, nbr, sim, fresh = node[new], nbr[new], sim[new], np.logical_and.reduceat(fresh, np.flatnonzero(new))
            order = np.lexsort((nbr, -sim, node))
            node, nbr, sim, fresh = node[order], nbr[order], sim[order], fresh[order]
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            rank = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
            ok = rank < keep
            sizes = np.diff(np.append(first, len(node)))
            lows = np.where(sizes < keep, np.float32(-2), sim[first + np.minimum(sizes, keep) - 1])
            low = np.repeat(lows, sizes)
            yield pd.DataFrame({"node": node[ok], "nbr": nbr[ok], "sim": sim[ok], "fresh": fresh[ok], "low": low[ok], "head": rank[ok] == 0})

    return rows.repartition(n, "node").sortWithinPartitions("node").mapInPandas(best, EDGES + ", fresh boolean, low float, head boolean")


def top_of(sims: np.ndarray, keep: int) -> np.ndarray:
    return np.argpartition(-sims, keep - 1, axis=1)[:, :keep] if sims.shape[1] > keep else np.tile(np.arange(sims.shape[1]), (len(sims), 1))


class Tree:
    """A tree of planes, level by level: for each cell a normal and a threshold; then planes through the lowest cells' centres."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.levels, cells = [], [np.arange(len(sample))]
        fitted = min(depth, max(0, int(np.log2(max(1, len(sample)) / FITTED))))
        for _ in range(fitted):
            normals, at, halves = np.zeros((len(cells), sample.shape[1]), np.float32), np.zeros(len(cells), np.float32), []
            for c, own in enumerate(cells):
                a, b = sample[rng.choice(own, 2, replace=False)] if len(own) > 1 else rng.standard_normal((2, sample.shape[1]))
                normals[c] = a - b
                along = sample[own] @ normals[c]
                at[c] = np.median(along) if len(own) else 0
                halves += [own[along <= at[c]], own[along > at[c]]]
            self.levels.append((normals, at))
            cells = halves
        self.centres = np.stack([sample[own].mean(axis=0) if len(own) else np.zeros(sample.shape[1]) for own in cells]).astype(np.float32)
        self.deeper = rng.standard_normal((sample.shape[1], depth - fitted)).astype(np.float32)

    def cell(self, x: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(x), np.int64)
        for normals, at in self.levels:
            cell = 2 * cell + (np.einsum("ij,ij->i", x, normals[cell]) > at[cell])
        bits = (x - self.centres[cell]) @ self.deeper > 0
        return (cell << bits.shape[1]) + bits @ (1 << np.arange(bits.shape[1], dtype=np.int64))


def forest(vectors: DataFrame, count: int, n: int, keep: int, trees: int, leaf: int, seed: int = 3) -> DataFrame:
    """Edges between nodes that share a leaf of a tree, the best keep per node and leaf."""
    depth = max(0, int(np.ceil(np.log2(max(1, count) / leaf))))
    sample = codes(vectors.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(SAMPLE).select("code").toPandas()["code"])
    rng = np.random.default_rng(seed)
    grown = vectors.sparkSession.sparkContext.broadcast([Tree(sample, depth, rng) for _ in range(trees)])

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = codes(f["code"])
            for t, tree in enumerate(grown.value):
                yield pd.DataFrame({"cell": tree.cell(x) * trees + t, "node": f["node"], "code": f["code"]})

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a cell far larger than a leaf is compared in stretches
        for f, starts in whole_groups(frames, "cell", most=2 * leaf):
            x, ids = codes(f["code"]), f["node"].to_numpy()
            out = []
            for c, d in zip(starts, np.append(starts[1:], len(f))):
                if d - c > 1:
                    s = x[c:d] @ x[c:d].T
                    np.fill_diagonal(s, -9)
                    near = top_of(s, min(keep, d - c - 1))
                    rows = np.repeat(np.arange(d - c), near.shape[1])
                    out.append((ids[c:d][rows], ids[c:d][near.ravel()], s[rows, near.ravel()]))
            if out:
                node, nbr, sim = map(np.concatenate, zip(*out))
                yield pd.DataFrame({"node": node, "nbr": nbr, "sim": sim})[sim > -9]

    cells = vectors.select("node", "code").mapInPandas(dealt, "cell long, node long, code binary")
    # hash order inside a cell makes stretches random parts of it
    return cells.repartition(n, "cell").sortWithinPartitions("cell", F.xxhash64("node")).mapInPandas(compared, EDGES)


def listed(edges: DataFrame, n: int, reverse: int) -> DataFrame:
    """Each node's own list and the best reverse of those that list it, dealt by node; a pair may be there twice."""
    own = edges.select("node", "nbr", "sim", "fresh", F.lit(True).alias("own"))
    back = edges.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "sim", "fresh", F.lit(False).alias("own"))
    place = F.row_number().over(Window.partitionBy("node", "own").orderBy(F.desc("sim"), "nbr"))
    return own.unionByName(back).repartition(n, "node").withColumn("k", place).where(F.col("own") | (F.col("k") <= reverse)).select("node", "nbr", "fresh")


def around(edges: DataFrame, n: int, reverse: int) -> DataFrame:
    """(node, nbr, fresh): what is around each node around which something is fresh, keep + reverse rows of a node at most; dealt by node."""
    sets = listed(edges, n, reverse).groupBy("node").agg(F.collect_set("nbr").alias("all"), F.collect_set(F.when(F.col("fresh"), F.col("nbr"))).alias("new"))
    return sets.where(F.size("new") > 0).select("node", F.explode("all").alias("nbr"), "new").withColumn("fresh", F.array_contains("new", F.col("nbr"))).drop("new")


def descend(edges: DataFrame, vectors: DataFrame, count: int, n: int, keep: int, reverse: int) -> DataFrame:
    """One round: pairs of nodes around a common node, one of them new there, that improve on either's list."""
    lows = edges.where("head").select(F.col("node").alias("nbr"), "low")
    sent = vectors.select(F.col("node").alias("nbr"), "code").join(small(lows, count), "nbr")

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, starts in whole_groups(frames, "node"):
            x, ids, low, fresh = codes(f["code"]), f["nbr"].to_numpy(), f["low"].to_numpy(), f["fresh"].to_numpy()
            out = []
            for a, b in zip(starts, np.append(starts[1:], len(f))):
                if b - a > 1 and fresh[a:b].any():
                    s = x[a:b] @ x[a:b].T
                    np.fill_diagonal(s, -9)
                    i, j = np.nonzero((s > low[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b]))
                    out.append((ids[a:b][i], ids[a:b][j], s[i, j]))
            if out:
                node, nbr, sim = map(np.concatenate, zip(*out))
                # what one task finds twice is sent once
                _, first = np.unique(np.stack([node, nbr]), axis=1, return_index=True) if len(node) < 1_000 else (0, unique_pairs(node, nbr))
                yield pd.DataFrame({"node": node[first], "nbr": nbr[first], "sim": sim[first]})

    near = around(edges, n, reverse).join(small(sent, count, CODES), "nbr")
    # a broadcast leaves the rows dealt by node
    near = near if count <= CODES else near.repartition(n, "node")
    found = near.sortWithinPartitions("node").mapInPandas(local, EDGES)
    return merged(edges.select("node", "nbr", "sim", F.lit(False).alias("fresh")).unionByName(found.withColumn("fresh", F.lit(True))), n, keep)


def unique_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order[new]


def build(spark: SparkSession, vectors: DataFrame, scratch: Scratch, neighbours: int, reverse: int, trees: int, leaf: int, settled: float, descents: int | None = None) -> DataFrame:
    """vectors(node, vec, code) -> the graph's adjacency (node, nbr).

    Lists only get better, so the rounds end by themselves; descents bounds their number, for comparison.
    """
    count = vectors.count()
    n = partitions(spark, count * neighbours)
    first = forest(vectors, count, n, FIRST, trees, leaf).withColumn("fresh", F.lit(True))
    edges = scratch.save(merged(first, n, neighbours), "edges-0")
    for turn in itertools.count(1) if descents is None else range(1, descents + 1):
        edges = scratch.save(descend(edges, vectors, count, n, neighbours, reverse), f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
        replaced, entries = edges.agg(F.count_if("fresh"), F.count("*")).first()
        if replaced <= settled * entries:
            break
    return scratch.save(listed(edges, n, 2 * reverse).select("node", "nbr").distinct(), "graph")


@F.pandas_udf(FloatType())
def dots(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.einsum("ij,ij->i", floats(a), floats(b)) if len(a) else np.empty(0, np.float32))


def search(spark: SparkSession, starts: DataFrame, vectors: DataFrame, graph: DataFrame, scratch: Scratch, beam: int, expanded: int) -> DataFrame:
    """starts(node): nodes to search from -> beams (q, node, sim), when no node of a beam is open any more."""
    asked = scratch.save(starts.join(vectors, "node").select(F.col("node").alias("q"), F.col("vec").alias("q_vec")), "asked")
    asked_rows, count = asked.count(), vectors.count()
    n = partitions(spark, asked_rows * beam)
    by_sim = Window.partitionBy("q").orderBy(F.desc("sim"), "node")

    def best(pairs: DataFrame) -> DataFrame:
        """(q, node, open) -> the beams, with go: the open nodes that are expanded next. A node is open unless any of its rows is not."""
        # from here on rows stay dealt by q, unless the vectors are too many to broadcast
        pairs = pairs.repartition(n, "q").groupBy("q", "node").agg(F.min("open").alias("open"))
        pairs = pairs.join(small(vectors.select("node", "vec"), count, VECTORS), "node").join(small(asked, asked_rows, VECTORS), "q")
        scored = pairs.select("q", "node", dots("q_vec", "vec").alias("sim"), "open")
        kept = scored.withColumn("k", F.row_number().over(by_sim)).where(F.col("k") <= beam)
        place = F.row_number().over(Window.partitionBy("q", "open").orderBy(F.desc("sim"), "node"))
        return kept.withColumn("go", F.col("open") & (place <= expanded)).drop("k")

    def reached(nodes: DataFrame, rows: int) -> DataFrame:
        return small(nodes, rows).join(graph, "node").where("q != nbr").select("q", F.col("nbr").alias("node"), F.lit(True).alias("open"))

    beams = scratch.save(best(reached(asked.select("q", F.col("q").alias("node")), asked_rows)), "beams-0")
    for turn in itertools.count(1):
        waiting = beams.where("go").select("q", "node")
        waiting_rows = waiting.count()
        if not waiting_rows:
            break
        closed = beams.select("q", "node", (F.col("open") & ~F.col("go")).alias("open"))
        beams = scratch.save(best(closed.unionByName(reached(waiting, waiting_rows))), f"beams-{turn}")
        scratch.drop(f"beams-{turn - 1}")
    return beams.select("q", "node", "sim")


def nearest(
    spark: SparkSession,
    rows: DataFrame,
    scratch: Scratch,
    query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    neighbours: int = NEIGHBOURS,
    reverse: int = REVERSED,
    trees: int = TREES,
    leaf: int = LEAF,
    settled: float = SETTLED,
    beam: int = BEAM,
    expanded: int = EXPANDED,
    descents: int | None = None,
) -> DataFrame:
    """The k nearest other ids of each id for which query (a condition on vec_id) holds: query_id, rank, vec_id, score."""
    found = scratch.save(usable(rows, vec_id, embedding), "usable")
    lengths = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return found.selectExpr("vec_id query_id", "cast(1 as int) rank", "vec_id", "cast(1 as double) score")
    found = found.where(F.size("v") == lengths["d"])
    # equal vectors are put together exactly; one vector may belong to a third of all rows
    equal = scratch.save(found.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("members")).where("members > 1"), "equal")
    ids = salted_join(found, equal, "v", "members", F.col("vec_id")).select("vec_id", F.coalesce("node", "vec_id").alias("node"), "v")
    ids = scratch.save(ids, "ids")
    one = ids.where("vec_id = node").select("node", "v")
    ids = ids.select("vec_id", "node")

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f["v"])
            x = (x / np.abs(x).max(axis=1, keepdims=True))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            # the graph is built from half floats, searched with floats, and the results are scored with doubles
            yield pd.DataFrame({"node": f["node"], "vec": [r.tobytes() for r in x.astype(np.float32)], "code": [r.tobytes() for r in x.astype(np.float16)]})

    vectors = scratch.save(one.mapInPandas(packed, "node long, vec binary, code binary"), "vectors")
    graph = build(spark, vectors, scratch, neighbours, reverse, trees, leaf, settled, descents)
    asking = ids.where(query)
    beams = search(spark, asking.select("node").distinct(), vectors, graph, scratch, beam, expanded)
    # equal vectors: a node's k + 1 smallest ids can be among a query's nearest, no others
    few = ids.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("k") <= k + 1).drop("k")
    few = scratch.save(few, "few")
    near = beams.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "node"))).where(F.col("k") <= 3 * k).select("q", "node")
    near = near.unionByName(asking.select(F.col("node").alias("q"), "node").distinct())
    pairs = near.join(one.select(F.col("node").alias("q"), F.col("v").alias("a")), "q").join(one.withColumnRenamed("v", "b"), "node")
    scores = scratch.save(pairs.select("q", "node", cosine(F.col("a"), F.col("b")).alias("score")), "scores")
    reps = scores.join(few, "node").select("q", "vec_id", "score")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    reps = reps.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k + 1).drop("k")
    out = asking.select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).join(reps, "q").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark), F.col("vec_id") % 50 == 0)
