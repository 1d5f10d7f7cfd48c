"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

Texts become weighted counts of hashed words and word shapes (runs of upper case, lower case, digits
and other characters). A singular value decomposition of a bounded sample of labelled rows gives the
latent space. The sample's vectors are broadcast; every document is compared with all of them by exact
blocked cosine products, and its nearest neighbours vote with their similarity; those that tie with the
last of them vote too, so that copies in the sample have no order.

Defined results: null and empty texts have no term and get the sample's share of good rows as score;
null ids and repeated rows give one row each; null labels are no labels; of a labelled id with several
texts the one with the least terms in byte order is learnt; without any labelled row every
score is 0.5; an empty table gives an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusloom.llm.textbytes import BASE, VALUE, Texts, batches, power_table, scrambled

#: Labelled rows that are fitted and broadcast, whatever the input's size: the bound of the sample.
SAMPLE_ROWS = 4_000
TERMS = 2_048
DIMENSIONS = 64
BLOCK = 256
#: Cosines this much apart are a tie.
TIED = 1e-5

SHAPE = np.full(256, 0, np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58] = 1, 2, 3
SHAPE[128:] = 1
for _k, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    SHAPE[_c] = 4 + _k


def shape_hash(t: Texts) -> np.ndarray:
    """Hash of each word's shape: its byte classes with runs made one."""
    kinds = SHAPE[t.data]
    new = np.ones(len(kinds), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[t.starts] = True
    nth = np.cumsum(new) - 1
    sums = np.zeros(len(kinds) + 1, np.uint64)
    np.cumsum(np.where(new, VALUE[kinds] * power_table(BASE, len(kinds))[nth], np.uint64(0)), out=sums[1:])
    back = power_table(pow(BASE, -1, 1 << 64), len(kinds))
    return scrambled((sums[t.ends] - sums[t.starts]) * back[nth[t.starts]])


def term_counts(t: Texts) -> np.ndarray:
    """Texts x 2 TERMS: damped shares of hashed words and of hashed shapes; the last cell has words that repeat the one before."""
    out = np.empty((t.n, 2 * TERMS), np.float32)
    words = t.span_hash(t.starts, t.ends)
    for k, hashes in enumerate((words, shape_hash(t))):
        cells = t.doc * TERMS + (hashes % np.uint64(TERMS)).astype(np.int64)
        out[:, k * TERMS : (k + 1) * TERMS] = np.bincount(cells, minlength=t.n * TERMS).reshape(t.n, TERMS)
    again = np.flatnonzero((words[1:] == words[:-1]) & (t.doc[1:] == t.doc[:-1])) + 1
    out[:, -1] = np.bincount(t.doc[again], minlength=t.n)
    out /= np.maximum(t.n_words, 1).astype(np.float32)[:, None]
    return np.sqrt(out, out=out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    weights: np.ndarray  # inverse document frequencies
    basis: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # unit vectors of the sample
    labels: np.ndarray
    neighbours: int

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit((counts * self.weights) @ self.basis)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of good neighbours, weighted by similarity, in blocks against the whole sample."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        balance = prior / (1 - prior) if 0.5 < prior < 1 else 1.0  # votes of the rarer, bad class count for more
        out = np.full(len(counts), prior)
        k = min(self.neighbours, len(self.labels))
        voices = np.where(self.labels > 0, 1, balance)
        for a in range(0, len(counts) if k else 0, BLOCK):
            cosine = self.latent(counts[a : a + BLOCK]) @ self.vectors.T
            last = np.partition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k]
            row, near = np.nonzero(cosine >= last[:, None] - TIED)
            weight = np.maximum(cosine[row, near], 0).astype(np.float64) ** 4 * voices[near]
            total, good = (np.bincount(row, w, minlength=len(cosine)) for w in (weight, weight * self.labels[near]))
            out[a : a + BLOCK] = np.where(total > 1e-9, good / np.maximum(total, 1e-9), prior)
        return np.clip(out, 0, 1)


def fit(counts: np.ndarray, labels: np.ndarray, neighbours: int, dimensions: int = DIMENSIONS, seed: int = 5) -> Model:
    """Inverse document frequencies and a randomised singular value decomposition of the sample."""
    if not len(labels):
        return Model(np.ones(2 * TERMS, np.float32), np.zeros((2 * TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, neighbours)
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = counts * weights
    d = min(dimensions, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], d + 8)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    basis = q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :d]
    model = Model(weights, basis.astype(np.float32), np.zeros((0, d), np.float32), labels.astype(np.float64), neighbours)
    model.vectors = model.latent(counts)
    return model


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", neighbours: int = 15, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labelled training rows with the smallest keyed hashes, sample_rows at most.

    Training rows are those whose crc32 of the id as text, modulo 5, is not 0.
    """
    key = F.col("doc_id").cast("string")
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(key) % 5 != 0))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, t in batches(frames, rows=BLOCK):
            yield pd.DataFrame({"doc_id": own["doc_id"], "label": own["label"], "counts": [c.astype(np.float16).tobytes() for c in term_counts(t)]})

    sample = texts.mapInPandas(counted, "doc_id long, label double, counts binary").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("counts").alias("counts")).toPandas().sort_values("doc_id")
    counts = np.frombuffer(b"".join(sample["counts"]), np.float16).astype(np.float32).reshape(len(sample), 2 * TERMS)
    return fit(counts, sample["label"].to_numpy(), neighbours)


def scored_text(spark: SparkSession, model: Model):
    """A column function text -> score, for filters that keep other columns."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        frames = batches(iter([pd.DataFrame({"text": texts.reset_index(drop=True)})]), rows=BLOCK)
        parts = [shared.value.scores(term_counts(t)) for _, t in frames]
        return pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return score


def classify(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs(doc_id, text) -> held_out, score and predicted; the model's size is bounded by its sample."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scored_text(spark, model)(F.col("text")).alias("score"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(spark, docs, train(spark, docs, labels)).select("doc_id", "held_out", "score", "predicted")
