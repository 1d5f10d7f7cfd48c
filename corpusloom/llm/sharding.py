"""Shuffled sharding: a keyed permutation of the global row numbers gives each row its shard and slot.

Row numbers follow the order of (doc_id, text, all other columns), so that a table gives the same shuffle
however its files are cut; rows equal in all columns may change places, which no result shows. A permutation is
a Feistel network over the least even number of bits that holds all rows, and walks on along its cycle where
it leaves them; it can be worked out both ways for any row without the others.

The law is rows: shards' counts are at most one apart, slots run from 0 without a gap. Copies of a text do not
stay together, since a third of all rows may be copies of one. Null ids come first, null texts have no bytes and
the checksum of the empty text. An empty table gives an empty one. Columns beyond doc_id and text go along only
where asked, inside one struct, so that their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corpusloom.llm.textbytes import scrambled
from corpusloom.session import Scratch, partitions

SHARDS, KEY, TURNS = 16, 2024, 6
#: Rows of a file that write_shards makes.
FILE_ROWS = 100_000


class Shuffle:
    """A permutation of 0..n-1 by a key, and the shards that it deals to."""

    def __init__(self, n: int, shards: int = SHARDS, key: int = KEY, turns: int = TURNS):
        self.n, self.shards = n, shards
        self.half = np.uint64(max(1, -(-max(1, n - 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = scrambled(np.arange(turns, dtype=np.uint64) + np.uint64(key % (1 << 63)) * np.uint64(turns))

    def through(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        """Once through the network, which permutes all numbers of twice half bits."""
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (scrambled(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (scrambled(right ^ k) & self.mask)
        return left << self.half | right

    def walk(self, rows: np.ndarray, back: bool = False) -> np.ndarray:
        out = self.through(np.asarray(rows).astype(np.uint64), back)
        # a walk along a cycle comes back to a number below n at the latest where it began
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self.through(out[far], back)
        return out.astype(np.int64)

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shards and slots of row numbers."""
        at = self.walk(rows)
        return at % self.shards, at // self.shards

    def row(self, shard: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Row numbers of shards and slots."""
        return self.walk(np.asarray(slot) * self.shards + np.asarray(shard), back=True)


def numbered(spark: SparkSession, rows: DataFrame, scratch: Scratch, *order: str) -> tuple[DataFrame, int]:
    """rows with row: its place, from 0, in the order; and the number of rows.

    Rows that the order can't part are parted by where they were read, so that a large group of them does not
    stay in one task. Numbers are counted within sorted ranges; only the ranges' sizes meet on the driver.
    """
    rows = scratch.save(rows.withColumn("_read", F.monotonically_increasing_id()), "narrow")
    ranges = partitions(spark, rows.count())
    dealt = rows.repartitionByRange(ranges, *order, "_read").sortWithinPartitions(*order, "_read").withColumn("_at", F.monotonically_increasing_id())
    dealt = scratch.save(dealt.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_read"), "ranges")
    scratch.drop("narrow")
    sizes = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).astype(int).tolist()
    starts = spark.createDataFrame([(k, b) for (k, _), b in zip(sizes, before)], "_range long, _before long")
    return dealt.join(F.broadcast(starts), "_range").withColumn("row", F.col("_before") + F.col("_at")).drop("_range", "_at", "_before"), before[-1]


def place(spark: SparkSession, docs: DataFrame, scratch: Scratch, shards: int = SHARDS, key: int = KEY, whole: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, size, text_crc32, row, shard, slot; whole adds the struct doc of all columns."""
    text = F.coalesce("text", F.lit(""))
    own = {"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text), "_text": F.unhex(F.sha2(text, 256)), "_rest": F.xxhash64(*docs.columns)}
    narrow = docs.select("doc_id", *[c.alias(n) for n, c in own.items()], *([F.struct(*docs.columns).alias("doc")] if whole else []))
    rows, n = numbered(spark, narrow, scratch, "doc_id", "_text", "_rest")
    shuffle = Shuffle(n, shards, key)

    @F.pandas_udf(LongType())
    def walked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(shuffle.walk(x.to_numpy()))

    rows = rows.drop("_text", "_rest").withColumn("_to", walked("row"))
    return rows.withColumns({"shard": (F.col("_to") % shards).cast("int"), "slot": F.expr(f"_to div {shards}")}).drop("_to")


def write_shards(spark: SparkSession, docs: DataFrame, path: str, scratch: Scratch, shards: int = SHARDS, key: int = KEY, file_rows: int = FILE_ROWS) -> None:
    """All of docs under path/_shard=K: files of file_rows rows, each sorted by slot, with _slot beside the columns of docs."""
    placed = place(spark, docs, scratch, shards, key, whole=True)
    placed = placed.select(F.col("shard").alias("_shard"), F.expr(f"slot div {file_rows}").alias("_file"), F.col("slot").alias("_slot"), "doc.*")
    dealt = placed.repartition(partitions(spark, docs.count(), file_rows), "_shard", "_file").sortWithinPartitions("_shard", "_file", "_slot")
    dealt.drop("_file").write.partitionBy("_shard").option("maxRecordsPerFile", file_rows).mode("overwrite").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
