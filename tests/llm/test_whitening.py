"""Whitening against an eigendecomposition of the exact covariance, and odd vectors."""

from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import whitening as W
from tests.llm.helpers import parquet

VECTORS = "vec_id long, embedding array<double>, label int, n long, component int, v string, id int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "x", 3) for i, v in rows], VECTORS)


def check(spark, rows, usable, components=8):
    """Every column of the result against numpy on the usable vectors (id, entries)."""
    model = W.fit(spark, rows, components=components)
    got = W.whitened(spark, rows, model).collect()
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in usable], dtype=object)
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    c = np.array([[float(Fraction(int(e)) - Fraction(s, n)) for e, s in zip(row, sums)] for row in x])
    values, u = np.linalg.eigh(c.T @ c / n)
    values, u = values[::-1], u[:, ::-1]
    k = sum(values[:components] > 1e-12 * values[0])
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    trace = values.sum()
    for (i, v), row, own in zip(usable, x, c):
        deviation = sum((n * int(e) - s) ** 2 for e, s in zip(row, sums))
        rows_of = {r["component"]: r for r in by[(i, deviation)]}
        assert sorted(rows_of) == list(range(1, k + 1))
        for j in range(k):
            assert rows_of[j + 1]["n"] == n and rows_of[j + 1]["identity_error"] <= 1e-9
            assert rows_of[j + 1]["explained"] == pytest.approx(values[j] / trace, rel=1e-10)
    for j in range(k):
        if (j == 0 or values[j - 1] > values[j] * 1.0001) and (j + 1 == len(values) or values[j] > values[j + 1] * 1.0001):
            want, have = c @ u[:, j] / np.sqrt(values[j]), c @ model.vectors[:, j] / np.sqrt(model.values[j])
            assert np.abs(want * np.sign(want @ have) - have).max() < 1e-6
            found = sorted(r["whitened"] for r in got if r["component"] == j + 1)
            assert found == pytest.approx(sorted(have), abs=1e-9)
    return model


def test_table(spark):
    rows = parquet(spark, "embeddings", "0.01")
    model = check(spark, rows, [(r["vec_id"], r["embedding"]) for r in rows.collect()])
    assert model.residual <= W.TOLERANCE and model.turns < 60


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = [(k, (rng.standard_normal(5) * [9, 4, 2, 1, 0.5]).tolist()) for k in range(40)] + [(None, [1.0] * 5), (7, [0.0] * 5), (7, [0.0] * 5)] + [(1 << 60, [3.0] * 5)] * 30
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0, 3.0, 4.0]), (93, [float("nan")] * 5), (94, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (95, [1.0, 2.0]), (96, [1e300] * 5)]
    check(spark, vectors(spark, good + bad).repartition(3), good)
    check(spark, vectors(spark, good + bad), good, components=2)


def test_without_variance_or_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5):
        df = vectors(spark, rows)
        found = W.whitened(spark, df, W.fit(spark, df))
        assert found.columns[0] == "vec_id" and found.count() == 0
    flat = [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)]
    model = check(spark, vectors(spark, flat), flat)
    assert len(model.values) == 1


def test_eigenpairs_of_close_values():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    values = np.concatenate([[5, 5, 5 - 1e-6, 3], np.linspace(2.99, 1, 86)])
    v = q @ np.diag(values) @ q.T
    x, e, residual, turns = W.lobpcg(lambda b: v @ b, 90, 4)
    assert e == pytest.approx(values[:4], rel=1e-12) and residual <= W.TOLERANCE and turns < 200
    assert np.abs(x.T @ x - np.eye(4)).max() < 1e-12


def test_whole_sums_at_any_size(spark):
    big = float((1 << 42) - 1024)
    rows = vectors(spark, [(k, [big, 1.0, -big]) for k in range(6)] + [(9, [big, 2.0, 1.0])])
    model = W.fit(spark, rows)
    e = [int(np.floor(1024 * c)) + 100_000 for c in (big, 1.0, -big, 2.0)]
    assert (model.n, model.sums) == (7, (7 * e[0], 6 * e[1] + e[3], 6 * e[2] + 101_024))
    assert {r["deviation"] for r in W.whitened(spark, rows, model).collect()} == {None}
