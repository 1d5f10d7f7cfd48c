"""From raw documents to packed training sequences, in five stages.

Quality classifier, near-duplicate join, secret scan, mixing and packing: each stage reads what its
predecessor kept. The first four return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.stages import deduplicate, mask_secrets, mix_sources, pack_sequences, quality
from corpusloom.session import Scratch

STAGES = [("quality_classifier", quality), ("ngram_jaccard_join", deduplicate), ("secret_scan", mask_secrets), ("mixing", mix_sources), ("best_fit_packing", pack_sequences)]

#: The classifier, the join's components and the mix's permutations have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
