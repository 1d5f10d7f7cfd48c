"""The pipeline's stages: each takes (spark, docs, sf_dir) and calls one operator on all that its predecessor kept.

All but the last return the columns of documents; further columns are carried along. Null ids, null texts
and empty tables are handled as each operator says; documents may lack n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.mixing import mix, mixed_texts
from corpusloom.llm.ngram_join import near_duplicates
from corpusloom.llm.packing import pack
from corpusloom.llm.quality_knn import scored_text, train
from corpusloom.llm.secrets import redacted
from corpusloom.session import Scratch, salted_join, small

#: Helper column of the join stage; it holds the hash of a text.
TEXT_ID = "_stage_text_id"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(scored_text(spark, model)(F.col("text")) >= 0.3)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates.

    Rows that share an id but are not alike all stay, as do documents without an id or a word; of rows with
    one id and one text the first in the order of their columns stays.
    """
    scratch = Scratch(spark)
    found = scratch.save(near_duplicates(spark, docs, scratch), "found").where("doc_id is not null")
    groups = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_id")).alias("first"), F.count("*").alias("members")).where("members > 1")
    beside = salted_join(found, scratch.save(groups, "groups"), "component", "members", F.col("text_id"))
    gone = scratch.save(beside.where("struct(doc_id, text_id) != first").select("doc_id", F.col("text_id").alias(TEXT_ID)).distinct(), "gone")
    repeated = found.groupBy("doc_id", F.col("text_id").alias(TEXT_ID)).count().where("count > 1").drop("count")
    repeated = scratch.save(repeated, "repeated")
    marked = docs.withColumn(TEXT_ID, F.xxhash64("text"))
    kept, key = marked.join(small(gone, gone.count()), ["doc_id", TEXT_ID], "left_anti"), ["doc_id", TEXT_ID]
    several = small(repeated, repeated.count())
    row = F.struct(*docs.columns)
    once = kept.join(several, key, "left_semi").groupBy(*key).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.join(several, key, "left_anti").select(docs.columns).unionByName(once)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets; n_chars, where there is one, follows the text."""
    masked = docs.withColumn("text", redacted("text"))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return masked.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document and epoch; n_chars, where there is one, follows the text."""
    taken = mixed_texts(spark, docs, mix(spark, docs, Scratch(spark)))
    if "n_chars" in docs.columns:
        taken = taken.withColumn("n_chars", F.length("text").cast("long"))
    return taken.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins."""
    return pack(spark, docs, Scratch(spark))
