"""Best-fit packing with several permitted sequence lengths.

Documents are cut into pieces no longer than the largest length. Pieces are dealt by hash to shards of
bounded size; inside a shard each piece, longest first, goes to the open bin with the least room that
holds it. Where none holds it, the length that promises the least cost per word is opened, judged by
filling it with the pieces still to come; at the end each bin shrinks to the shortest permitted length
that holds its contents.

Defined results: null or empty texts have no piece and stand in no bin; null ids are packed like
others; repeated rows are counted first and told apart by copy; an empty table gives an empty result;
columns that are not named are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.words import word_count
from corpusloom.session import Scratch

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SHARD_PIECES = 10_000
SCHEMA = "doc_id long, text_id long, copy long, piece long, begin long, length long, bin_id long, bin_offset long, capacity long"


def least(capacities: tuple, length: int) -> int:
    return capacities[bisect_left(capacities, length)]


def best_length(first: int, sizes: list[int], left: Counter, capacities: tuple, bin_cost: int) -> int:
    """The length to open for a piece of size first: least (length after shrinking + bin_cost) per word, filled longest first from left."""
    best = None
    for capacity in capacities[bisect_left(capacities, first) :]:
        room, used = capacity - first, Counter()
        top = bisect_right(sizes, min(room, first))
        while top:
            size = sizes[top - 1]
            fits = min(left[size] - used[size], room // size)
            if fits > 0:
                used[size] += fits
                room -= fits * size
            top = min(top - 1, bisect_right(sizes, room))
        content = capacity - room
        cost = (least(capacities, content) + bin_cost) / content
        if best is None or cost < best[0]:
            best = (cost, capacity)
    return best[1]


def best_fit(lengths: list[int], capacities: tuple = CAPACITIES, bin_cost: int = 32) -> tuple[list[int], list[int], list[int]]:
    """Bin of each length (given longest first), its offset there, and the final length of each bin."""
    left, sizes = Counter(lengths), sorted(set(lengths))
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    open_bins: dict[int, list[int]] = {}
    content: list[int] = []
    capacity: list[int] = []
    bins, offsets = [], []
    for length in lengths:
        left[length] -= 1
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
        else:
            b = len(content)
            content.append(0)
            capacity.append(best_length(length, sizes, left, capacities, bin_cost))
        bins.append(b)
        offsets.append(content[b])
        content[b] += length
        if (room := capacity[b] - content[b]) > 0:
            if room not in open_bins:
                insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append(b)
    return bins, offsets, [least(capacities, c) for c in content]


def pack(spark: SparkSession, docs: DataFrame, scratch: Scratch, capacities: tuple = CAPACITIES, bin_cost: int = 32, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """docs(doc_id, text) -> one row per piece: its words (begin, length), its bin and place there, and the bin's final length.

    A bin belongs to the shard bin_id >> 32. A shard holds about shard_pieces pieces whatever the input's size.
    """
    capacities, top = tuple(sorted(capacities)), max(capacities)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), word_count(F.col("text")).alias("size"))
    rows = rows.where("size > 0").groupBy("doc_id", "text_id", "size").count()
    rows = rows.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / 1000))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("lot") * 1000, F.least(F.col("count"), (F.col("lot") + 1) * 1000) - 1)))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / top))))
    begin = F.col("piece") * top
    pieces = scratch.save(pieces.select("doc_id", "text_id", "copy", "piece", begin.alias("begin"), F.least(F.lit(top), F.col("size") - begin).cast("long").alias("length")), "pieces")
    shards = -(-max(1, pieces.count()) // shard_pieces)

    def packed(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", "doc_id", "text_id", "copy", "piece"], ascending=[False, True, True, True, True], kind="stable", na_position="last")
        bins, offsets, final = best_fit(own["length"].tolist(), capacities, bin_cost)
        out = own[["doc_id", "text_id", "copy", "piece", "begin", "length"]].copy()
        out["bin_id"], out["bin_offset"] = [(int(key[0]) << 32) + b for b in bins], offsets
        out["capacity"] = [final[b] for b in bins]
        return out

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_id", "copy", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(packed, SCHEMA)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
