"""How filters hide behind each other: what each would remove, at each place of each order.

A document's failures are a mask of five bits. Per part three histograms of 32 masks (all documents, those
labelled good, those labelled toxic) are the rows of a whole-number matrix; one product with four fixed
matrices of 32 masks by 600 places (120 orders of five steps) gives every count of every order at once.

Null texts are empty, a null part is the empty string. A document is good (toxic) if any label row of its id
says so; null ids have no label, equal no smaller id and are none. Repeated rows count one by one. An empty
table gives an empty result. Columns beyond doc_id, text and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.words import WORD
from corpusloom.session import Scratch

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
MASKS = 1 << STEPS
#: Places: order by order, step by step.
PLACES = [(order, step) for order in ORDERS for step in range(1, STEPS + 1)]
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def outcomes() -> dict[str, np.ndarray]:
    """For each outcome a matrix, masks by places: 1 where documents of the mask have it there."""
    out = {name: np.zeros((MASKS, len(PLACES)), np.int64) for name in ("kept", "removed", "redundant", "unique_fails")}
    for at, (order, step) in enumerate(PLACES):
        own = 1 << FILTERS.index(order[step - 1])
        before = sum(1 << FILTERS.index(f) for f in order[: step - 1])
        for mask in range(MASKS):
            out["kept"][mask, at] = not mask & (before | own)
            out["removed"][mask, at] = mask & own and not mask & before
            out["redundant"][mask, at] = mask & own and bool(mask & before)
            out["unique_fails"][mask, at] = mask == own
    return out


def shares() -> np.ndarray:
    """Places by places: 1 where both ask for the same filter; sums what it removes over all orders and steps."""
    own = np.array([order[step - 1] for order, step in PLACES])
    return (own[:, None] == own[None, :]).astype(np.int64)


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D, which look at a text alone."""

    def bits(x: Column) -> Column:
        n, distinct = F.size(x["w"]), F.size(F.array_distinct(x["w"]))
        fails = [n < 50, 100 * distinct < 65 * n, 100 * F.regexp_count(x["t"], F.lit("[A-Z]")) > 5 * F.length(x["t"]), F.regexp_like(x["t"], F.lit(r"[#$%&*|]"))]
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))

    return F.transform(F.array(F.struct(text.alias("t"), F.regexp_extract_all(text, F.lit(WORD), 0).alias("w"))), bits)[0]


def masks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs(doc_id, text, source) -> (doc_id, part, mask, n), rows that are equal in all three counted in n.

    A text's smallest id is found from partial minima; only the pair of text and id is joined back, so no copy's
    rows meet in one task.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), text_mask(text).alias("mask"))
    rows = scratch.save(read.groupBy("sha", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "masked")
    firsts = rows.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    again = F.col("first").isNull() & F.col("doc_id").isNotNull()
    found = rows.join(firsts, ["sha", "doc_id"], "left")
    return found.select("doc_id", "part", (F.col("mask") + F.when(again, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"), "n")


def histograms(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, masks array<struct<mask, n, good, toxic>>), at most 32 masks for a part."""
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    once = found.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(said, "doc_id", "left")
    sums = {"n": F.sum("n"), "good": F.sum(F.col("n") * F.coalesce("good", F.lit(0))), "toxic": F.sum(F.col("n") * F.coalesce("toxic", F.lit(0)))}
    cells = once.groupBy("part", "mask").agg(*[c.alias(n) for n, c in sums.items()])
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", *sums)).alias("masks"))


def audited(hists: DataFrame) -> DataFrame:
    """The counts of every part, order and step, by one product of matrices for each batch of parts."""

    def multiplied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by, share = outcomes(), shares()
        orders, steps = [o for o, _ in PLACES], [s for _, s in PLACES]
        for frame in frames:
            for begin in range(0, len(frame), 256):
                own = frame.iloc[begin : begin + 256]
                h = np.zeros((3, len(own), MASKS), np.int64)
                for at, cells in enumerate(own["masks"]):
                    for c in cells:
                        h[:, at, c["mask"]] = c["n"], c["good"], c["toxic"]
                counts = {name: h[0] @ m for name, m in by.items()} | {"good_lost": h[1] @ by["removed"], "toxic_lost": h[2] @ by["removed"]}
                counts["shapley"] = counts["removed"] @ share
                yield pd.DataFrame({"part": np.repeat(own["part"].to_numpy(object), len(PLACES)), "filter_order": orders * len(own), "step": np.array(steps * len(own), np.int32)} | {name: c.ravel() for name, c in counts.items()})

    return hists.mapInPandas(multiplied, SCHEMA)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audited(histograms(masks(docs, Scratch(spark)), labels))
