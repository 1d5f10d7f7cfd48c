"""Mixing sources to target weights, with DataFrame functions only.

The words of each source form one stream, cut into blocks of a fixed number of words. Output shards
draw multinomial source counts; the slots of a source walk through pseudorandom permutations of its
block indexes, one permutation per epoch, and are joined to documents by block index.

Defined results: null texts have size 0, null sources are a source of their own that comes last, null
and repeated doc_ids are ordinary rows (each input row gives one output row), an empty table gives an
empty result, and columns that are not named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.words import word_count
from corpusloom.session import Scratch, partitions, running_sum, small

WEIGHTS = (3, 1, 2)
ROUNDS = 24


@dataclass
class Mix:
    """sources: one row per source; slots: one row per block drawn; rows: one row per document."""

    sources: DataFrame
    slots: DataFrame
    rows: DataFrame


def source_key(source: Column) -> Column:
    """A non-null key: 'v' and the name, or '' for null."""
    return F.coalesce(F.concat(F.lit("v"), source.cast("string")), F.lit(""))


def targets(totals: DataFrame, share: float, most: float, weights: tuple = WEIGHTS) -> DataFrame:
    """totals(skey, source_size) with sid, weight and target.

    Sources by code point, null last, have repeating weights. Raising one level, each source gets
    weight * level until it reaches its cap: the level is found from running sums by cap / weight.
    """
    order = Window.orderBy((F.col("skey") == "").cast("int"), "skey")
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = totals.withColumn("sid", F.row_number().over(order).cast("long"))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    wanted = F.sum("source_size").over(every) * F.lit(float(share))
    left = wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left / weight)
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "sid", "level"))).over(every)["level"]
    return t.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * level), F.col("cap"))).select("skey", "sid", "weight", "source_size", "target")


def permuted(x: Column, n: Column, key: Column, back: bool = False, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 (or its inverse): in each round x either keeps its place or swaps it with its mirror image about a keyed point."""
    steps = F.sequence(F.lit(rounds), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(rounds))

    def step(at: Column, k: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, k), n) - at, n)
        swap = F.xxhash64(key, k, F.greatest(at, mirror)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(at)

    return F.aggregate(steps, x.cast("long"), step)


def mix(
    spark: SparkSession,
    docs: DataFrame,
    scratch: Scratch,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple = WEIGHTS,
    block_words: int = 1024,
    shard_blocks: int = 512,
    bucket_rows: int = 2048,
    seed: int = 17,
) -> Mix:
    """Plan a mix whose source totals are the rounded targets.

    Rows alike in id, text and source are counted first and lie one behind the other. A source has a hash
    bucket for each bucket_rows of them; offsets are running sums inside a bucket plus the bucket's start,
    so that no task holds a whole source.
    """
    size, B = block_words, block_words
    rows = docs.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("skey"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("thash"))
    rows = scratch.save(rows.groupBy("doc_id", "skey", "thash", "size").agg(F.count("*").alias("copies")), "sizes")
    totals = scratch.save(rows.groupBy("skey").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.ceil(F.count("*") / bucket_rows).alias("n_buckets")), "totals")
    n_sources = totals.count()
    rows = rows.join(small(totals.select("skey", "n_buckets"), n_sources), "skey").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "thash"), F.col("n_buckets"))).drop("n_buckets")
    held = scratch.save(rows.groupBy("skey", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("bucket_size")), "buckets")
    sources = targets(totals.drop("n_buckets"), share, most, weights)
    want = F.round("target").cast("long")
    n = F.greatest(F.lit(1), F.ceil(F.col("source_size") / size)).cast("long")
    sources = sources.withColumn("n", n).withColumn("last", F.col("source_size") - (F.col("n") - 1) * B)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.when(F.col("source_size") > 0, want - F.col("epochs") * F.col("source_size")).otherwise(0))
    sources = sources.withColumn("short_at", permuted(F.col("n") - 1, F.col("n"), F.xxhash64(F.lit(seed), "sid", "epochs"), back=True))
    whole, late = F.ceil(F.col("rest") / B), F.ceil((F.col("rest") + B - F.col("last")) / B)
    sources = sources.withColumn("quota", (F.col("epochs") * F.col("n") + F.when(F.col("short_at") >= whole, whole).otherwise(late)).cast("long"))
    sources = scratch.save(sources.withColumn("quota", F.when(F.col("source_size") > 0, F.col("quota")).otherwise(0)), "sources")

    held = running_sum(held, "bucket_size", "bucket", "skey").select("skey", "bucket", F.col("upto").alias("start"))
    inside = Window.partitionBy("skey", "bucket").orderBy("doc_id", "thash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    rows = rows.join(held, ["skey", "bucket"]).join(small(sources.select("skey", "sid", "source_size", "target"), n_sources), "skey")
    rows = rows.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / 1000))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("lot") * 1000, F.least(F.col("copies"), (F.col("lot") + 1) * 1000) - 1)))
    rows = rows.withColumn("off", F.col("start") + F.col("inside") + F.col("copy") * F.col("size")).select("doc_id", "skey", "thash", "copy", "sid", "size", "source_size", "target", "off")

    slots = draw(spark, sources, scratch, shard_blocks, seed)
    epoch, at = F.floor(F.col("g") / F.col("n")), F.col("g") % F.col("n")
    slots = slots.withColumn("epoch", epoch).withColumn("at", at)
    slots = slots.withColumn("block", permuted(F.col("at"), F.col("n"), F.xxhash64(F.lit(seed), "sid", "epoch")))
    length = F.when(F.col("block") == F.col("n") - 1, F.col("last")).otherwise(B)
    before = F.col("at") * B - F.when(F.col("short_at") < F.col("at"), B - F.col("last")).otherwise(0)
    words = F.when(F.col("epoch") < F.col("epochs"), length).otherwise(F.greatest(F.lit(0), F.least(length, F.col("rest") - before)))
    slots = slots.withColumn("words", words.cast("long")).select("shard", "sid", "g", "epoch", "block", "words")
    return Mix(sources, slots, rows)


def draw(spark: SparkSession, sources: DataFrame, scratch: Scratch, shard_blocks: int, seed: int) -> DataFrame:
    """Slots (shard, sid, g and the source's columns): multinomial counts per shard, then settled.

    Each slot of a shard draws one of all quota points, which makes a shard's counts multinomial in
    proportion to the quotas. A source's surplus draws are handed to sources that got too few, by
    laying both on one axis, so that every source ends with its quota.
    """
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    axis = sources.where("quota > 0").select("sid", "quota").withColumn("lo", F.coalesce(F.sum("quota").over(upto), F.lit(0)))
    axis = axis.withColumn("hi", F.col("lo") + F.col("quota")).withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / shard_blocks), F.floor((F.col("hi") - 1) / shard_blocks))))
    shards = -(-total // shard_blocks)
    points = spark.range(0, shards, 1, min(max(1, shards), partitions(spark, total))).withColumnRenamed("id", "shard")
    points = points.withColumn("u", F.explode(F.sequence(F.lit(0), F.least(F.lit(shard_blocks), F.lit(total) - F.col("shard") * shard_blocks) - 1)))
    points = points.withColumn("z", F.pmod(F.xxhash64(F.lit(seed), "shard", "u"), F.lit(max(1, total)))).withColumn("cell", F.floor(F.col("z") / shard_blocks))
    drawn = points.join(axis, "cell").where("z >= lo and z < hi").groupBy("shard", "sid").agg(F.count("*").alias("cnt"))
    drawn = running_sum(scratch.save(drawn, "counts"), "cnt", "shard", "sid").withColumnRenamed("upto", "g0").join(sources.select("sid", "quota"), "sid")
    drawn = scratch.save(drawn.withColumn("kept", F.greatest(F.lit(0), F.least("cnt", F.col("quota") - F.col("g0")))), "drawn")

    holes = scratch.save(drawn.groupBy("shard").agg(F.sum(F.col("cnt") - F.col("kept")).alias("free")).where("free > 0"), "holes")
    holes = running_sum(holes, "free", "shard").withColumnRenamed("upto", "lo").withColumn("hi", F.col("lo") + F.col("free"))
    got = drawn.groupBy("sid").agg(F.sum("kept").alias("got"))
    lacks = sources.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).withColumn("lack", F.col("quota") - F.col("got")).where("lack > 0")
    lacks = lacks.select("sid", "got", "lack").withColumn("from", F.coalesce(F.sum("lack").over(upto), F.lit(0))).withColumn("to", F.col("from") + F.col("lack"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / shard_blocks), F.floor((F.col(b) - 1) / shard_blocks)))
    settled = holes.withColumn("cell", cells("lo", "hi")).join(lacks.withColumn("cell", cells("from", "to")), "cell")
    at = F.greatest("lo", "from", F.col("cell") * shard_blocks)
    end = F.least("hi", "to", (F.col("cell") + 1) * shard_blocks)
    settled = settled.where(end > at).select("shard", "sid", (F.col("got") + at - F.col("from")).alias("g0"), (end - at).alias("cnt"))
    given = drawn.where("kept > 0").select("shard", "sid", "g0", F.col("kept").alias("cnt")).unionByName(settled)
    given = given.join(sources.select("sid", "n", "last", "epochs", "rest", "short_at"), "sid")
    return given.withColumn("g", F.explode(F.sequence(F.col("g0"), F.col("g0") + F.col("cnt") - 1))).drop("g0", "cnt")


def pieces(m: Mix, block_words: int = 1024) -> DataFrame:
    """Per document row and block: its word range in the block (lo, hi) and its start in the document."""
    first, final = F.floor(F.col("off") / block_words), F.floor(F.greatest("off", F.col("off") + F.col("size") - 1) / block_words)
    cut = m.rows.withColumn("block", F.explode(F.sequence(first, final)))
    lo = F.greatest(F.lit(0), F.col("off") - F.col("block") * block_words)
    hi = F.least(F.lit(block_words), F.col("off") + F.col("size") - F.col("block") * block_words)
    return cut.withColumn("lo", lo).withColumn("hi", hi).withColumn("begin", F.col("block") * block_words + F.col("lo") - F.col("off"))


def taken(m: Mix, block_words: int = 1024) -> DataFrame:
    """One row per document: how many of its words the mix takes, repeats counted."""
    full = F.col("epoch") < F.col("epochs")
    per_block = m.slots.join(m.sources.select("sid", "epochs"), "sid").groupBy("sid", "block").agg(F.count_if(full).alias("times"), F.max(F.when(~full, F.col("words"))).alias("part"))
    joined = pieces(m, block_words).join(per_block, ["sid", "block"], "left")
    words = F.coalesce("times", F.lit(0)) * (F.col("hi") - F.col("lo")) + F.greatest(F.lit(0), F.least("hi", F.coalesce("part", F.lit(0))) - F.col("lo"))
    return joined.withColumn("words", words).groupBy("doc_id", "sid", "thash", "copy", "size", "source_size", "target").agg(F.sum("words").cast("long").alias("taken"))


KEYS = ["m_id", "m_hash", "m_source"]


def numbered(spark: SparkSession, marked: DataFrame, m: Mix, lots: int = 64) -> DataFrame:
    """marked(KEYS, m_row) with m_copy, the number of a row among those alike in id, text and source.

    Few rows have others like them; those are dealt to lots and numbered lot by lot, so that even a third
    of all rows, alike, are not sorted in one task.
    """
    scratch = Scratch(spark)
    again = scratch.save(m.rows.where("copy = 1").select(source_key(F.col("doc_id")).alias("m_id"), F.col("thash").alias("m_hash"), F.col("skey").alias("m_source")), "again")
    n = again.count()
    if not n:
        return marked.withColumn("m_copy", F.lit(0))
    alike = scratch.save(marked.join(small(again, n), KEYS, "left_semi").withColumn("m_lot", F.pmod(F.monotonically_increasing_id(), F.lit(lots))), "alike")
    before = running_sum(scratch.save(alike.groupBy(*KEYS, "m_lot").count(), "lots"), "count", "m_lot", *KEYS).drop("count")
    nth = F.row_number().over(Window.partitionBy(*KEYS, "m_lot").orderBy("m_lot"))
    alike = alike.withColumn("m_copy", nth - 1).join(before, [*KEYS, "m_lot"]).select(*marked.columns, (F.col("m_copy") + F.col("upto")).alias("m_copy"))
    return marked.join(small(again, n), KEYS, "left_anti").withColumn("m_copy", F.lit(0)).unionByName(alike)


def mixed_texts(spark: SparkSession, docs: DataFrame, m: Mix, block_words: int = 1024, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with the mix applied: one row per document and epoch, its text the words taken in that epoch.

    Whole documents keep their text byte for byte; others keep the taken words with the white space before them.
    What the plan of the mix gives is written first, so that the driver never holds all of it as one plan.
    """
    scratch = Scratch(spark)
    m = Mix(m.sources, scratch.save(m.slots, "slots"), scratch.save(m.rows, "rows"))
    ranges = pieces(m, block_words).where("hi > lo").join(m.slots.where("words > 0").select("sid", "block", "epoch", "words"), ["sid", "block"])
    ranges = ranges.withColumn("len", F.least("hi", "words") - F.col("lo")).where("len > 0")
    ranges = ranges.select(source_key(F.col("doc_id")).alias("m_id"), F.col("thash").alias("m_hash"), F.col("skey").alias("m_source"), F.col("copy").alias("m_copy"), "size", "epoch", "begin", "len")
    ranges = ranges.groupBy(*KEYS, "m_copy", "size", "epoch").agg(F.array_sort(F.collect_list(F.struct("begin", "len"))).alias("parts"), F.sum("len").alias("words"))
    ranges = ranges.groupBy(*KEYS, "m_copy", "size").agg(F.collect_list(F.struct("epoch", "words", "parts")).alias("takes"))
    ranges = scratch.save(ranges, "ranges")
    marked = docs.select(source_key(F.col(id_column)).alias("m_id"), F.xxhash64(F.col(text)).alias("m_hash"), source_key(F.col(source)).alias("m_source"), F.struct(*docs.columns).alias("m_row"))
    out = numbered(spark, marked, m).join(ranges, [*KEYS, "m_copy"]).select("m_row", "size", F.explode("takes").alias("take"))
    words = F.regexp_extract_all(F.col(f"m_row.{text}"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(F.flatten(F.transform("take.parts", lambda p: F.slice(words, p["begin"].cast("int") + 1, p["len"].cast("int")))), "")
    chosen = F.when(F.col("take.words") == F.col("size"), F.col(f"m_row.{text}")).otherwise(part)
    return out.select(*[chosen.alias(c) if c == text else F.col("m_row")[c].alias(c) for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = mix(spark, docs, Scratch(spark))
    return taken(m).select("doc_id", "size", "source_size", "target", "taken")
