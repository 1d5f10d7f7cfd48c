"""Connected components of an edge table in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import Scratch


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges(a, b) -> (id, component) for every id in an edge; component is the smallest id reached.

    Each round points every label to the least label beside it, follows pointers twice, and contracts
    the edges to the new labels; rounds end when no edge joins two labels. Tables are written between
    rounds, so lost executors cost one round at most.
    """
    edges = scratch.save(edges.select("a", "b").where("a != b").distinct(), f"{name}-edges-0")
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    labels = scratch.save(labels, f"{name}-labels-0")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = scratch.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), f"{name}-hooks-{turn}")
        for jump in range(2):
            onward = hooks.select(F.col("a").alias("to"), F.col("to").alias("next"))
            hooks = scratch.save(hooks.join(onward, "to", "left").select("a", F.coalesce("next", "to").alias("to")), f"{name}-hooks-{turn}-{jump}")
        onward = hooks.select(F.col("a").alias("component"), F.col("to").alias("next"))
        labels = scratch.save(labels.join(onward, "component", "left").select("id", F.coalesce("next", "component").alias("component")), f"{name}-labels-{turn}")
        side = lambda c: hooks.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        moved = edges.join(side("a"), "a").join(side("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        edges = scratch.save(moved.where("a != b").distinct(), f"{name}-edges-{turn}")
        scratch.drop(f"{name}-edges-{turn - 1}", f"{name}-labels-{turn - 1}", *(f"{name}-hooks-{turn}{x}" for x in ("", "-0", "-1")))
    return labels
