"""Exact nearest neighbours by blocks, with partial and final top-k.

A stated query set that fits one block is sent to the items, which then stay where they are; otherwise both sides
are dealt to blocks of bounded size, and each pair of blocks meets in one task as one matrix product. What a task
keeps of its products (all, the best of each query, their least and greatest) is gathered while it reads, so
only that leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import Scratch, small

#: Rows of a block of either side, and queries up to which they are broadcast.
BLOCK = 4096
#: Products that a task makes at once, whatever the numbers of queries and items.
CELLS = 1 << 18
#: Vectors that blocks of a threshold join lie around, rows they are chosen from, and the width of a block in radians.
PIVOTS, PIVOT_ROWS, BAND = 48, 4096, 0.15
#: Cells of a search for the best at most, share of all products up to which it is made by cells, and queries that this is estimated from.
CENTRES, SHARE, TRIED = 4096, 0.25, 512


def matrix(column: pd.Series, unit_length: bool = False) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if unit_length else x


class Pairs:
    """Every product of least or more."""

    fields = "score double"

    def __init__(self, queries: np.ndarray, least: float = -np.inf):
        self.queries, self.least = queries, least

    def add(self, items: np.ndarray, scores: np.ndarray) -> Iterator[pd.DataFrame]:
        rows, cols = np.nonzero(scores >= self.least)
        yield pd.DataFrame({"query": self.queries[rows], "item": items[cols], "score": scores[rows, cols]})

    def end(self) -> Iterator[pd.DataFrame]:
        yield from ()


class Best:
    """The k best items of each query, equal to 9 places by item, each beside the query's least and greatest product."""

    fields = "score double, low double, high double"

    def __init__(self, queries: np.ndarray, k: int, least: float = -np.inf):
        self.queries, self.k, self.least = queries, k, least
        self.low, self.high = np.full(len(queries), np.inf), np.full(len(queries), -np.inf)
        self.floor = np.full(len(queries), least)
        self.pool: list[pd.DataFrame] = []
        self.held = 0

    def add(self, items: np.ndarray, scores: np.ndarray) -> Iterator[pd.DataFrame]:
        if scores.size:
            self.low, self.high = np.minimum(self.low, scores.min(axis=1)), np.maximum(self.high, scores.max(axis=1))
            if scores.shape[1] > self.k:
                own = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
                self.floor = np.maximum(self.floor, own - 1e-9)
            rows, cols = np.nonzero(scores >= self.floor[:, None])
            self.pool.append(pd.DataFrame({"at": rows, "item": items[cols], "score": scores[rows, cols]}))
            self.held += len(rows)
            if self.held > 4 * len(self.queries) * self.k + 100_000:
                self.cut()
        yield from ()

    def cut(self) -> pd.DataFrame:
        all_of = pd.concat(self.pool, ignore_index=True)
        order = all_of.assign(by=-all_of["score"].round(9)).sort_values(["at", "by", "item"]).index
        best = all_of.loc[order].groupby("at", sort=False).head(self.k)
        full = best.groupby("at")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.floor[full.index] = np.maximum(self.floor[full.index], full["min"] - 1e-9)
        self.pool, self.held = [best], len(best)
        return best

    def end(self) -> Iterator[pd.DataFrame]:
        if self.pool:
            best = self.cut()
            at = best["at"].to_numpy()
            yield pd.DataFrame({"query": self.queries[at], "item": best["item"].to_numpy(), "score": best["score"].to_numpy(), "low": self.low[at], "high": self.high[at]})


class Extremes(Best):
    """The least and greatest product of each query."""

    fields = "low double, high double"

    def __init__(self, queries: np.ndarray):
        super().__init__(queries, 1)

    def add(self, items: np.ndarray, scores: np.ndarray) -> Iterator[pd.DataFrame]:
        if scores.size:
            self.low, self.high = np.minimum(self.low, scores.min(axis=1)), np.maximum(self.high, scores.max(axis=1))
        yield from ()

    def end(self) -> Iterator[pd.DataFrame]:
        seen = self.low <= self.high
        yield pd.DataFrame({"query": self.queries[seen], "low": self.low[seen], "high": self.high[seen]})


class Scaled(Best):
    """Best by products that are brought to 0..1 between a query's bounds, known before."""

    def __init__(self, queries: np.ndarray, k: int, bounds: pd.DataFrame):
        super().__init__(queries, k)
        own = bounds.reindex(queries)
        self.least_of, self.span_of = own["low"].to_numpy()[:, None], (own["high"] - own["low"]).to_numpy()[:, None]

    def add(self, items: np.ndarray, scores: np.ndarray) -> Iterator[pd.DataFrame]:
        yield from super().add(items, np.where(self.span_of == 0, 1.0, (scores - self.least_of) / np.where(self.span_of == 0, 1.0, self.span_of)))


def added(kept: Pairs | Best, queries: np.ndarray, items: pd.DataFrame, unit_length: bool, block: int = BLOCK) -> Iterator[pd.DataFrame]:
    """The products of queries with items(item, v), added to kept by pieces of CELLS."""
    step = max(1, min(block, CELLS // max(1, len(queries))))
    for a in range(0, len(items), step):
        part = items.iloc[a : a + step]
        yield from kept.add(part["item"].to_numpy(), queries @ matrix(part["v"], unit_length).T)


def folded(queries: DataFrame, items: DataFrame, keep: Callable[[np.ndarray], Pairs | Best], unit_length: bool = False, block: int = BLOCK) -> DataFrame:
    """queries(query, v) x items(item, v): what keep(query ids) makes of their products, or of their cosines.

    Null vectors take no part; all vectors need one length.
    """
    queries, items = (df.where("v is not null") for df in (queries.select("query", "v"), items.select("item", "v")))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query"), (items, "item"))}
    fields = keep(np.empty(0, object)).fields
    schema = f"query {kinds['query']}, {'' if fields == Extremes.fields else 'item ' + kinds['item'] + ', '}{fields}"
    asked = queries.limit(block + 1).toPandas()
    if len(asked) <= block:
        sent = items.sparkSession.sparkContext.broadcast((asked["query"].to_numpy(), matrix(asked["v"], unit_length)))

        def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            kept = keep(ids)
            for f in frames:
                if len(ids):
                    yield from added(kept, q, f, unit_length, block)
            yield from kept.end()

        return items.mapInPandas(scored, schema)
    q_blocks, i_blocks = -(-queries.count() // block), max(1, -(-items.count() // block))
    deal = lambda df, c, own, n_own, other, n_other: df.select(c, "v", F.pmod(F.xxhash64(c), F.lit(n_own)).cast("long").alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))).alias(other))
    return met(deal(queries, "query", "a", q_blocks, "b", i_blocks), deal(items, "item", "b", i_blocks, "a", q_blocks), keep, schema, unit_length)


def met(left: DataFrame, right: DataFrame, keep: Callable[[np.ndarray], Pairs | Best], schema: str, unit_length: bool) -> DataFrame:
    """left(query, v, a, b), right(item, v, a, b): products within each (a, b)."""
    kinds = {c: df.schema[c].dataType for df, c in ((left, "query"), (right, "item"))}
    left = left.select("query", F.lit(None).cast(kinds["item"]).alias("item"), "v", "a", "b", F.lit(0).alias("side"))
    right = right.select(F.lit(None).cast(kinds["query"]).alias("query"), "item", "v", "a", "b", F.lit(1).alias("side"))

    def product(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames), ignore_index=True)
        q, i = f[f["side"] == 0], f[f["side"] == 1]
        if len(q) and len(i):
            kept = keep(q["query"].to_numpy())
            yield from added(kept, matrix(q["v"], unit_length), i, unit_length)
            yield from kept.end()

    return left.unionByName(right).groupBy("a", "b").applyInPandas(product, schema)


def products(queries: DataFrame, items: DataFrame, unit_length: bool = False, block: int = BLOCK, least: float = -np.inf) -> DataFrame:
    """(query, item, score): all products, or cosines of unit_length, of least or more."""
    return folded(queries, items, lambda ids: Pairs(ids, least), unit_length, block)


def nearest(queries: DataFrame, items: DataFrame, k: int, unit_length: bool = False, block: int = BLOCK, least: float = -np.inf) -> DataFrame:
    """(query, item, score, rank): the k best items of each query with scores of least or more, those equal to 9 places ordered by item."""
    return first(folded(queries, items, lambda ids: Best(ids, k, least), unit_length, block).drop("low", "high"), k)


def first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("_by"), "item"))
    return found.withColumn("_by", F.round("score", 9)).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).drop("_by")


def normal(score: str = "score") -> F.Column:
    span = F.col("high") - F.col("low")
    return F.when(span == 0, 1.0).otherwise((F.col(score) - F.col("low")) / span)


def best_normal(queries: DataFrame, items: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query, item, raw, score, rank): the k best products, and these brought to 0..1 between the query's least and greatest.

    Of more queries than a block, equal vectors are searched for once, and by cells where these rule most products out.
    """
    queries, scratch = queries.select("query", "v").where("v is not null"), Scratch(items.sparkSession)
    if queries.limit(block + 1).count() <= block:
        return all_best(queries, items, k, block)
    queries = scratch.save(queries, "queries")
    once = scratch.save(queries.groupBy("v").agg(F.min("query").alias("same")), "once")
    asked = once.select(F.col("same").alias("query"), "v")
    top = best_by_cells(asked, items, k, block) if once.count() > block else None
    top = all_best(asked, items, k, block) if top is None else top
    return queries.join(once, "v").select("query", "same").join(top.withColumnRenamed("query", "same"), "same").select("query", "item", "raw", "score", "rank")


def all_best(queries: DataFrame, items: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """best_normal from all products, in one pass."""
    found = Scratch(items.sparkSession).save(folded(queries, items, lambda ids: Best(ids, k), block=block), "best")
    bounds = found.groupBy("query").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    top = first(found.drop("low", "high"), k)
    return top.join(bounds, "query").select("query", "item", F.col("score").alias("raw"), normal().alias("score"), "rank")


class Centres:
    """Items that all items lie around, each in the cell of its nearest, and how far and how long those of a cell are."""

    def __init__(self, v: np.ndarray, cells: pd.DataFrame | None = None):
        self.v, self.squares, self.cells = v, (v * v).sum(axis=1), cells

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = (self.squares - 2 * (v @ self.v.T)).argmin(axis=1)
        return cell, np.linalg.norm(v - self.v[cell], axis=1)

    def wanted(self, v: np.ndarray, k: int, sign: int) -> np.ndarray:
        """Queries by cells: whether one of the k greatest (least, with sign -1) products can lie there.

        A query's k-th best centre is one of the items. Of v around c no product q v is above that of the longest
        vector at the distance |q - c| - r from q, or above q c + |q| r.
        """
        c, t, square = self.cells, sign * (v @ self.v.T), (v * v).sum(axis=1, keepdims=True)
        floor = -np.partition(-t, k - 1, axis=1)[:, [k - 1]] if k <= t.shape[1] else np.full((len(v), 1), -np.inf)
        at, r, longest = c["cell"].to_numpy(), c["far"].to_numpy(), c["square"].to_numpy()
        t = t[:, at]
        away = np.maximum(0.0, np.sqrt(np.maximum(0.0, square + self.squares[at] - 2 * t)) - r)
        bound = np.minimum((square + longest - away**2) / 2, t + np.sqrt(square) * r)
        # products equal to 9 places are told apart by item, and sums are off by little
        return ~(bound < floor - 2e-9 - 1e-12 * (square + longest.max()))


def best_by_cells(queries: DataFrame, items: DataFrame, k: int, block: int = BLOCK) -> DataFrame | None:
    """all_best, by the products of queries with the cells of items that can hold a best or least one; None if these are too many."""
    spark, scratch = items.sparkSession, Scratch(items.sparkSession)
    queries, items = (df.where("v is not null") for df in (queries.select("query", "v"), items.select("item", "v")))
    n = items.count()
    centres = Centres(matrix(items.orderBy(F.xxhash64("item")).limit(min(CENTRES, int(2 * n**0.5) + 1)).toPandas()["v"]))
    if not n or not np.isfinite(centres.squares).all():
        return None
    step = max(1, CELLS // len(centres.v))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), step):
                part = f.iloc[a : a + step]
                v = matrix(part["v"])
                cell, far = centres.nearest(v)
                yield pd.DataFrame({"item": part["item"], "v": part["v"], "cell": cell.astype(np.int32), "far": far, "square": (v * v).sum(axis=1)})

    cells = scratch.save(items.mapInPandas(placed, f"item {items.schema['item'].dataType.simpleString()}, v array<double>, cell int, far double, square double"), "cells")
    stats = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("square").alias("square")).orderBy("cell").toPandas()
    if not np.isfinite(stats[["far", "square"]].to_numpy()).all():
        return None
    sent = spark.sparkContext.broadcast(Centres(centres.v, stats))
    tried = matrix(queries.orderBy(F.xxhash64("query")).limit(TRIED).toPandas()["v"])
    if any((sent.value.wanted(tried, most, sign) @ stats["n"].to_numpy()).mean() > SHARE * n for most, sign in ((k, 1), (1, -1))):
        return None

    def sought(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = sent.value
        names = centres.cells["cell"].to_numpy()
        for f in frames:
            for a in range(0, len(f), step):
                part = f.iloc[a : a + step]
                v = matrix(part["v"])
                for kind, (most, sign) in enumerate(((k, 1), (1, -1))):
                    wanted = centres.wanted(v, most, sign)
                    lists = np.split(names[np.nonzero(wanted)[1]].astype(np.int32), np.cumsum(wanted.sum(axis=1))[:-1])
                    yield pd.DataFrame({"query": part["query"], "v": part["v"], "cells": lists, "kind": np.full(len(part), kind, np.int32)})

    types = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query"), (items, "item"))}
    asked = scratch.save(queries.mapInPandas(sought, f"query {types['query']}, v array<double>, cells array<int>, kind int"), "asked")
    asked = asked.select("query", "v", F.explode("cells").alias("cell"), "kind")
    # a cell of more than block rows of either side is dealt out to lots
    lots = lambda n: F.ceil(F.col(n) / block).cast("long")
    plan = asked.groupBy("kind", "cell").agg(F.count("*").alias("m")).join(spark.createDataFrame(stats[["cell", "n"]].astype({"cell": "int32"}), "cell int, n long"), "cell")
    plan = scratch.save(plan.select("kind", "cell", lots("m").alias("q_lots"), lots("n").alias("i_lots")), "plan")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    at = lambda df, key: df.select(key, "v", F.col("cell").alias("a"), (F.col("x") * (1 << 20) + F.col("y")).alias("b"))

    def meeting(kind: int, keep: Callable[[np.ndarray], Best], schema: str) -> DataFrame:
        dealt = F.broadcast(plan.where(F.col("kind") == kind).drop("kind"))
        left = asked.where(F.col("kind") == kind).join(dealt, "cell").select("query", "v", "cell", own("query", "q_lots").alias("x"), other("i_lots").alias("y"))
        right = cells.join(dealt, "cell").select("item", "v", "cell", own("item", "i_lots").alias("y"), other("q_lots").alias("x"))
        return met(at(left, "query"), at(right, "item"), keep, f"query {types['query']}, {schema}", False)

    found = meeting(0, lambda ids: Best(ids, k), f"item {types['item']}, {Best.fields}").select("query", "item", "score")
    top = scratch.save(first(found.withColumn("high", F.max("score").over(Window.partitionBy("query"))), k), "best")
    low = meeting(1, Extremes, f"{Extremes.fields}").groupBy("query").agg(F.min("low").alias("low"))
    return top.join(low, "query").select("query", "item", F.col("score").alias("raw"), normal().alias("score"), "rank")


def all_normal(queries: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(query, item, raw, score): all products, also brought to 0..1 within a query. The bounds are gathered first, so that no pair is shuffled where queries are broadcast."""
    bounds = folded(queries, items, Extremes, block=block).groupBy("query").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    bounds = Scratch(items.sparkSession).save(bounds, "bounds")
    found = products(queries, items, block=block).join(small(bounds, bounds.count()), "query")
    return found.select("query", "item", F.col("score").alias("raw"), normal().alias("score"))


def best_scaled(queries: DataFrame, items: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query, item, score, rank): the k best of all_normal, those whose scores are equal to 9 places ordered by item, without a row for every pair."""
    bounds = folded(queries, items, Extremes, block=block).groupBy("query").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    sent = items.sparkSession.sparkContext.broadcast(bounds.toPandas().set_index("query"))
    found = folded(queries, items, lambda ids: Scaled(ids, k, sent.value), block=block).drop("low", "high")
    return first(Scratch(items.sparkSession).save(found, "best"), k)


# --- cosines above a threshold, with blocks that cannot hold any left out


def pivots(items: DataFrame) -> np.ndarray:
    """Directions far from each other, from the PIVOT_ROWS items with the least hashes that are not zero. They decide what is compared, never what is found."""
    x = matrix(items.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("item")).limit(PIVOT_ROWS).toPandas()["v"], True)
    x = x[np.linalg.norm(x, axis=1) > 0.5]
    if not len(x):
        return x
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(PIVOTS, len(x)) and near.min() < 0.999:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def celled(rows: DataFrame, key: str, centres: np.ndarray, block: int) -> DataFrame:
    """rows(key, v) with cell (nearest centre; -1 for zero vectors), band (angle to it), and the angle."""
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, v array<double>, cell int, band int, angle double"

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = matrix(f["v"], True)
                near = x @ centres.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(f)), cell], -1, 1))
                cell[~x.any(axis=1)] = -1
                yield pd.DataFrame({key: f[key], "v": f["v"], "cell": cell.astype(np.int32), "band": (angle / BAND).astype(np.int32), "angle": angle})

    return rows.select(key, "v").where("v is not null").mapInPandas(placed, schema)


def block_pairs(left: pd.DataFrame, right: pd.DataFrame, centres: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Places of the blocks (cell, low, high) of both sides that may hold vectors with a cosine of least or more.

    Angles obey the triangle inequality: between blocks around centres t apart no angle is below t - high - high,
    low - t - high or low' - t - high'.
    """
    far = np.arccos(np.clip(centres @ centres.T, -1, 1))
    t = far[np.ix_(left["cell"], right["cell"])]
    (a, b), (c, d) = ((side[["low"]].to_numpy(), side[["high"]].to_numpy()) for side in (left, right))
    bound = np.maximum.reduce([t - b - d.T, a - t - d.T, c.T - t - b])
    # an angle is off by about sqrt(eps) where vectors all but coincide; a zero vector has the cosine 0 with all others
    zero = (left["cell"].to_numpy()[:, None] < 0) | (right["cell"].to_numpy() < 0)
    return list(zip(*np.nonzero(np.where(zero, least <= 0, bound <= np.arccos(np.clip(least, -1, 1)) + 1e-6))))


def threshold_pairs(queries: DataFrame, items: DataFrame, least: float, block: int = BLOCK, counted: dict | None = None) -> DataFrame:
    """(query, item, score): all cosines of least or more. counted, if given, gets the products made and those of all pairs.

    Queries that fit one block go to the items, which costs queries times items; of larger sets, blocks that the
    angles between their centres rule out never meet.
    """
    if queries.limit(block + 1).count() <= block:
        return products(queries, items, True, block, least)
    scratch = Scratch(items.sparkSession)
    centres = pivots(items)
    if not len(centres):
        return products(queries, items, True, block, least) if least <= 0 else products(queries.where("false"), items.where("false"), True, block, least)
    sides = {}
    for name, rows in (("query", queries), ("item", items)):
        cells = scratch.save(celled(rows, name, centres, block), name)
        stats = cells.groupBy("cell", "band").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        sides[name] = cells, stats.orderBy("cell", "band").toPandas()
    (left, l_stats), (right, r_stats) = sides["query"], sides["item"]
    pairs = block_pairs(l_stats, r_stats, centres, least) if len(l_stats) and len(r_stats) else []
    if counted is not None:
        counted |= {"made": int(sum(l_stats["n"][i] * r_stats["n"][j] for i, j in pairs)), "all": int(l_stats["n"].sum() * r_stats["n"].sum())}
    lots = lambda n: -(-int(n) // block)
    spark = items.sparkSession
    plan = [(int(l_stats["cell"][i]), int(l_stats["band"][i]), int(r_stats["cell"][j]), int(r_stats["band"][j]), lots(l_stats["n"][i]), lots(r_stats["n"][j]), at) for at, (i, j) in enumerate(pairs)]
    plan = spark.createDataFrame(plan, "lc int, lb int, rc int, rb int, l_lots int, r_lots int, pair long")
    # a pair of blocks of more than block rows is dealt out to lots of both sides
    span = F.lit(1 << 20)
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("long")
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    l_rows = left.join(F.broadcast(plan), (F.col("cell") == F.col("lc")) & (F.col("band") == F.col("lb"))).select("query", "v", "pair", own("query", "l_lots").alias("x"), other("r_lots").alias("y"))
    r_rows = right.join(F.broadcast(plan), (F.col("cell") == F.col("rc")) & (F.col("band") == F.col("rb"))).select("item", "v", "pair", own("item", "r_lots").alias("y"), other("l_lots").alias("x"))
    at = lambda df, key: df.select(key, "v", F.col("pair").alias("a"), (F.col("x") * span + F.col("y")).alias("b"))
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, {Pairs.fields}"
    return met(at(l_rows, "query"), at(r_rows, "item"), lambda ids: Pairs(ids, least), kinds, True)
