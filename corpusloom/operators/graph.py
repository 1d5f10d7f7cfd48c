"""Tables of the entity-passage graph, from triples (chunk, s, p, o).

Nulls never stand in triples (valid_triples drops them); repeated triples of a chunk count each; empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.extraction import long_enough
from corpusloom.functions.scores import dot, mean_vector, truncated_min_max
from corpusloom.operators.knn import threshold_pairs
from corpusloom.session import Scratch


def mentions(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("s", "o")).alias("entity"), "chunk").distinct()


def facts(triples: DataFrame) -> DataFrame:
    return triples.select("s", "p", "o").distinct()


def fact_documents(triples: DataFrame) -> DataFrame:
    return triples.select("s", "p", "o", "chunk").distinct()


def fact_edges(triples: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Co-occurrence counts of both directions, without self edges; chunks in known(chunk) have been counted before."""
    triples = triples if known is None else triples.join(known, "chunk", "left_anti")
    both = triples.select(F.explode(F.array(F.struct(F.col("s").alias("src"), F.col("o").alias("dst")), F.struct(F.col("o").alias("src"), F.col("s").alias("dst")))).alias("e")).select("e.*")
    return both.where("src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def passage_edges(mentioned: DataFrame, directed: bool = True) -> DataFrame:
    """Entity and passage joined with weight 1, both ways if directed."""
    there = mentioned.select(F.col("entity").alias("src"), F.col("chunk").alias("dst"), F.lit(1.0).alias("weight"))
    return there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")) if directed else there


def merged_undirected(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair: of the two orientations the first in name order gives the weight."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min_by("weight", "src").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b, weight) as (src, dst, weight) of both directions."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))).alias("e")).select("e.*").distinct()


def self_loops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A loop of weight 0 for each node that has none."""
    own = edges.where("src = dst").select(F.col("src").alias("node"))
    return nodes.join(own, "node", "left_anti").select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("weight"))


def node_kinds(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """names(node) with kind: passage for chunks(chunk), entity else."""
    known = chunks.select(F.col("chunk").alias("node"), F.lit("passage").alias("kind")).distinct()
    return names.join(known, "node", "left").select("node", F.coalesce("kind", F.lit("entity")).alias("kind"))


def edge_kinds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with kind: loop, passage (an end is a passage), else entity; edges with an end beyond nodes(node, kind) go."""
    e = edges.join(nodes.select(F.col("node").alias("src"), F.col("kind").alias("_a")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("kind").alias("_b")), "dst")
    kind = F.when(F.col("src") == F.col("dst"), "loop").when((F.col("_a") == "passage") | (F.col("_b") == "passage"), "passage").otherwise("entity")
    return e.select(*edges.columns, kind.alias("kind"))


def prior_norm(edges: DataFrame, **how) -> DataFrame:
    """edges(kind, weight, ...) with prior_norm: truncated min-max of the weights of entity edges, 0 on all others."""
    normed = truncated_min_max(edges.where("kind = 'entity'"), "weight", to="prior_norm", **how)
    return normed.unionByName(edges.where("kind != 'entity'").withColumn("prior_norm", F.lit(0.0)))


def diversity(mentioned: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per entity mean |x|^2 - |mean x|^2 over its passages; 0 with fewer than two."""
    rows = mentioned.join(vectors.select("chunk", "v", dot(F.col("v"), F.col("v")).alias("sq")), "chunk")
    sums = rows.groupBy("entity").agg(F.avg("sq").alias("sq"), mean_vector(F.col("v")).alias("mean"), F.count("*").alias("n"))
    return sums.select("entity", F.when(F.col("n") < 2, 0.0).otherwise(F.col("sq") - dot(F.col("mean"), F.col("mean"))).alias("diversity"))


def diversity_norm(nodes: DataFrame, spread: DataFrame, **how) -> DataFrame:
    """nodes(node, kind) with diversity and norm: entities that no passage mentions have diversity 0, passages the norm 0.5."""
    entities = nodes.where("kind = 'entity'").join(spread.withColumnRenamed("entity", "node"), "node", "left").withColumn("diversity", F.coalesce("diversity", F.lit(0.0)))
    passages = nodes.where("kind = 'passage'").withColumns({"diversity": F.lit(0.0), "norm": F.lit(0.5)})
    return truncated_min_max(entities, "diversity", **how).select("node", "kind", "diversity", "norm").unionByName(passages)


def synonyms(entities: DataFrame, threshold: float = 0.8, most: int | None = 101, new: DataFrame | None = None) -> DataFrame:
    """entities(entity, v) -> (src, dst, weight): for each source the most cosine neighbours at the threshold or above, all without most.

    Entities of two letters or fewer look for none; blank ones are never found. With new(entity, v), some of the
    entities, only pairs with at least one of them are made and compared: united with what earlier calls found,
    their first of each source are those of all entities together.
    """
    asking = lambda df: df.where(long_enough(F.col("entity"))).select(F.col("entity").alias("query"), "v")
    found = lambda df: df.where(F.trim("entity") != "").select(F.col("entity").alias("item"), "v")
    if new is None:
        near = alike(asking(entities), found(entities), threshold, most)
    else:
        old = entities.join(new.select("entity"), "entity", "left_anti")
        near = alike(asking(new), found(entities), threshold, most).unionByName(alike(asking(old), found(new), threshold, most))
    return nearest_sources(near.where("query != item").select(F.col("query").alias("src"), F.col("item").alias("dst"), F.col("score").alias("weight")), most)


def alike(queries: DataFrame, items: DataFrame, least: float, most: int | None) -> DataFrame:
    """(query, item, score): cosines of least or more; with most at least the most nearest items of each query beside itself.

    Equal vectors are compared once. No query can keep more than most and itself of the items of one vector, nor of
    all items near its vector, so that the first of these by name stand for the rest.
    """
    scratch = Scratch(items.sparkSession)
    q, i = (scratch.save(df.where("v is not null"), name) for df, name in ((queries, "asking"), (items, "found")))
    kinds = [df.groupBy("v").agg(F.min(key).alias(key)) for df, key in ((q, "query"), (i, "item"))]
    kinds = [scratch.save(k, name) for k, name in zip(kinds, ("query-kinds", "item-kinds"))]
    near = scratch.save(threshold_pairs(*kinds, least).select(F.col("query").alias("q_kind"), F.col("item").alias("i_kind"), "score"), "near")
    q, i = (df.join(k.withColumnRenamed(key, to), "v").select(key, to) for df, k, key, to in ((q, kinds[0], "query", "q_kind"), (i, kinds[1], "item", "i_kind")))
    listed = near.join(first_of(i, "i_kind", most, "item"), "i_kind").select("q_kind", "item", "score")
    listed = first_of(listed, "q_kind", most, F.desc(F.round("score", 9)), "item")
    return q.join(listed, "q_kind").select("query", "item", "score")


def first_of(rows: DataFrame, by: str, most: int | None, *order) -> DataFrame:
    """rows: the first most and one more of each by; all without most."""
    if most is None:
        return rows
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_nth") <= most + 1).drop("_nth")


def nearest_sources(pairs: DataFrame, most: int | None) -> DataFrame:
    """pairs(src, dst, weight): the most of each source, those equal to 9 places by name; all without most."""
    if most is None:
        return pairs.select("src", "dst", "weight")
    nth = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("weight", 9)), "dst"))
    return pairs.withColumn("_nth", nth).where(F.col("_nth") <= most).select("src", "dst", "weight")


def overridden(edges: DataFrame, by: DataFrame) -> DataFrame:
    """edges with the weights of by(src, dst, weight) in their place, where it has the ordered pair, and its other pairs added."""
    return edges.join(by, ["src", "dst"], "left_anti").unionByName(by)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) with both ends among nodes(node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def appended(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored edges and the new ones whose ends, in either order, are not joined yet; stored weights stay.

    Of several new edges of one pair the first counts: by ord, where new has it, else the orientation first in
    name order, then the least weight.
    """
    key = lambda df, *more: df.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight", *more)
    order = F.struct("ord", "src", "weight") if "ord" in new.columns else F.struct("src", "weight")
    fresh = key(new, order.alias("_at")).where("a != b").join(key(stored).select("a", "b"), ["a", "b"], "left_anti")
    return key(stored).unionByName(fresh.groupBy("a", "b").agg(F.min_by("weight", "_at").alias("weight")))


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(node, ...) and edges(src, dst, ...) without gone(node)."""
    gone = gone.select("node").distinct()
    edges = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return nodes.join(gone, "node", "left_anti"), edges


def graph_info(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes of both kinds, and edges of each kind (fact, passage, synonym, loop)."""
    counts = nodes.agg(F.count_if(F.col("kind") == "entity").alias("entities"), F.count_if(F.col("kind") == "passage").alias("passages"))
    of = lambda k: edges.agg(F.count_if(F.col("kind") == k)).scalar()
    return counts.withColumns({"fact_edges": of("fact"), "passage_edges": of("passage"), "synonym_edges": of("synonym")})
