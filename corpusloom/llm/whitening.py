"""Whitening of embeddings by LOBPCG, with products of covariance and block added up over the rows.

No table of all vectors and no covariance matrix is ever made on the driver: each turn sends one block of at
most 3 * (components + GUARD) directions to the rows, and gets back the covariance times that block, summed in
two levels. The eigenpairs are taken once their residuals, from fresh products, are below the tolerance.

Rows take part whose vector is not null, holds no null and no entry that isn't finite or is 2^42 or more in
size (whose whole numbers are not exact), and has the commonest length (of equally common ones the longest).
Zero vectors and repeated rows take part like all others; null ids stay null. Components without variance,
which can't be whitened, are left out, so that fewer than the asked number may come back; no usable rows give
an empty table. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import bound_batches

COMPONENTS = 8
#: Columns that the iterate has beyond the asked ones: they part these from what follows them.
GUARD = 8
#: Largest residual |V u - e u|, over the largest eigenvalue, with which an eigenpair is taken; turns go on to GOAL while they gain.
TOLERANCE, GOAL = 1e-11, 1e-14
ROUNDS = 300
#: Eigenvalues below this share of the largest are taken for zero.
NOTHING = 1e-12
SCALE, SHIFT, LIMIT = 1024, 100_000, float(1 << 42)
#: Rows after which a task passes on its whole-number sums, and groups in which tasks' sums meet first.
FLUSH, LOTS = 1 << 20, 64
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """n rows, the exact sums of their entries, unit eigenvectors as columns, their eigenvalues, the trace, the largest residual over the largest eigenvalue, and the turns taken."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    turns: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.vectors / np.sqrt(self.values))


def entries(batch: pa.RecordBatch, length: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and whole-number entries, as doubles, of the usable vectors of a batch (id, v)."""
    ids, v = batch.column(0), batch.column(1)
    fits = pc.equal(pc.fill_null(pc.list_value_length(v), -1), length)
    ids, v = ids.filter(fits), v.filter(fits)
    x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, length)
    good = (np.abs(x) < LIMIT).all(axis=1)
    return ids.filter(pa.array(good)), np.floor(SCALE * x[good]) + SHIFT


def added(rows: DataFrame, length: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of part(entries of some rows), a flat array of one size."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = part(entries(batch, length)[1]).ravel()
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"lot": pa.array([TaskContext.get().partitionId() % LOTS], pa.int32()), "s": pa.array([total.tolist()], pa.list_(pa.float64()))})

    met = rows.mapInArrow(sums, "lot int, s array<double>").select("lot", array_to_vector("s").alias("s")).groupBy("lot").agg(Summarizer.sum(F.col("s")).alias("s"))
    return np.array(met.agg(vector_to_array(Summarizer.sum(F.col("s"))).alias("s")).first()["s"])


def exact_sums(rows: DataFrame, length: int) -> tuple[int, tuple[int, ...]]:
    """The number of rows and the sums of their entries, exact at any size: entries are added in two halves of 26 bits."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            cells = np.concatenate([[n], high, low])
            return pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(len(cells)), pa.int32()), "s": pa.array(cells, pa.int64())})

        n, high, low = 0, np.zeros(length, np.int64), np.zeros(length, np.int64)
        for batch in batches:
            x = entries(batch, length)[1].astype(np.int64)
            n, high, low = n + len(x), high + (x >> 26).sum(axis=0), low + (x & ((1 << 26) - 1)).sum(axis=0)
            if n >= FLUSH:
                yield out()
                n, high, low = 0, np.zeros(length, np.int64), np.zeros(length, np.int64)
        yield out()

    found = rows.mapInArrow(sums, "cell int, s long").groupBy("cell").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    cells = [int(s) for _, s in sorted((r["cell"], r["s"]) for r in found)] or [0] * (2 * length + 1)
    return cells[0], tuple((h << 26) + lo for h, lo in zip(cells[1 : length + 1], cells[length + 1 :]))


def orthonormal(new: np.ndarray, *held: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of new add to the orthonormal blocks held; directions lost to rounding are dropped."""
    for turn in range(2):
        norms = np.linalg.norm(new, axis=0)
        new = new[:, norms > (1e-8 if turn else 0)] / norms[norms > (1e-8 if turn else 0)]
        for block in held:
            new = new - block @ (block.T @ new)
    if not new.size:
        return new
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    return u[:, s > 1e-7 * max(1.0, s[0])]


def lobpcg(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, guard: int = GUARD, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The largest eigenpairs of a symmetric matrix known by its products with blocks: vectors, values, largest residual over the largest value, turns.

    Each turn solves the problem within the span of the iterate, its residuals and its last directions of
    change (Rayleigh-Ritz); residuals come from that turn's product. Raises where they do not reach TOLERANCE.
    """
    width = min(size, wanted + guard)
    x = np.linalg.qr(np.random.default_rng(11).standard_normal((size, width)))[0]
    basis, last = x, np.inf
    for turn in range(1, rounds + 1):
        image = product(basis)
        h = basis.T @ image
        values, y = np.linalg.eigh((h + h.T) / 2)
        values, y = values[::-1][:width], y[:, ::-1][:, :width]
        change = basis[:, width:] @ y[width:]
        x = basis @ y
        gap = image @ y - x * values
        top = max(values[0], 0.0)
        residual = float(np.linalg.norm(gap[:, :wanted], axis=0).max() / top) if top > 0 else 0.0
        if residual <= GOAL or (residual <= TOLERANCE and residual > last / 2):
            return x[:, :wanted], values[:wanted], residual, turn
        last = residual
        x = np.linalg.qr(x)[0]
        r = orthonormal(gap, x)
        basis = np.hstack([x, r, orthonormal(change, x, r)])[:, :size]
    raise ArithmeticError(f"eigenvectors not certified after {rounds} turns: residual {last}")


def fit(spark: SparkSession, rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows' vectors; None where no row is usable."""
    bound_batches(spark)
    lengths = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None
    d, read = lengths["d"], rows.select(F.lit(0).alias("id"), F.col(vector).alias("v"))
    n, sums = exact_sums(read, d)
    if n == 0:
        return None
    mean = np.array([float(Fraction(s, n)) for s in sums])
    trace = []

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return np.append((c.T @ (c @ block)).ravel(), (c * c).sum())

        total = added(read, d, part) / n
        trace.append(float(total[-1]))
        return total[:-1].reshape(block.shape)

    vectors, values, residual, turns = lobpcg(product, d, min(components, d))
    kept = values > NOTHING * max(values[0], 0.0)
    vectors, values = vectors[:, kept], values[kept]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[largest, np.arange(vectors.shape[1])])
    return Whitening(n, sums, vectors, values, trace[-1], residual, turns)


def identity_error(rows: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest entry of the whitened rows' covariance minus the identity, over all rows, centred first."""
    k, d = len(model.values), len(model.sums)
    read = rows.select(F.lit(0).alias("id"), F.col(vector).alias("v"))
    mean = added(read, d, lambda x: model.project(x).sum(axis=0)) / model.n

    def part(x: np.ndarray) -> np.ndarray:
        w = model.project(x) - mean
        return w.T @ w

    return float(np.abs(added(read, d, part).reshape(k, k) / model.n - np.eye(k)).max())


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2; null where one exceeds a long. Wrapped 64-bit sums are exact where the result fits."""
    about = ((model.n * (x - model.mean)) ** 2).sum(axis=1)
    wrap = lambda v: (v + (1 << 63)) % (1 << 64) - (1 << 63)
    sums = np.array([wrap(s) for s in model.sums], np.int64)
    with np.errstate(over="ignore"):
        gap = x.astype(np.int64) * np.int64(model.n) - sums
        out = (gap * gap).sum(axis=1)
    return [int(v) if a < 9.2e18 else None for v, a in zip(out, about)]


def whitened(spark: SparkSession, rows: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {OUT}"
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    error, k, d = identity_error(rows, model, vector), len(model.values), len(model.sums)
    share = model.values / model.trace

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = entries(batch, d)
            at = np.repeat(np.arange(len(x)), k)
            columns = [
                ids.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(at), model.n), pa.int64()),
                pa.array(deviations(x, model), pa.int64()).take(pa.array(at)), pa.array(model.project(x).ravel(), pa.float64()),
                pa.array(np.tile(share, len(x)), pa.float64()), pa.array(np.full(len(at), error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, *(c.split()[0] for c in OUT.split(", "))])

    return rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInArrow(made, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitened(spark, rows, fit(spark, rows))
