"""Quantiles, block products, threshold joins and ranks against plain numpy, with bounds so small that every path is taken."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.scores import quantiles, truncated_min_max
from corpusloom.operators import graph as G
from corpusloom.operators import knn
from corpusloom.operators import retrieval as R
from corpusloom.session import Scratch


def test_quantiles_of_large_groups(spark):
    rng = np.random.default_rng(2)
    groups = {"normal": rng.standard_normal(3000), "ties": rng.choice([0.0, 1.0, 1.0, 5.0], 3000), "one": np.full(2500, 7.0), "wide": np.exp(rng.uniform(-300, 300, 2000)), "small": rng.uniform(size=30), "lone": np.array([3.0])}
    rows = Scratch(spark).save(spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("small", None)], "g string, x double"), "rows")
    at = (0.0, 0.01, 0.5, 0.99, 1.0)
    for held in (40, 100_000):
        got = {r["g"]: [r[f"q{k}"] for k in range(len(at))] for r in quantiles(rows, "x", ("g",), at, held).collect()}
        assert got == {g: pytest.approx(list(np.quantile(x, at)), rel=1e-12) for g, x in groups.items()}
    whole = quantiles(rows.where("g = 'normal'"), "x", (), at, 40).first()
    assert [whole[f"q{k}"] for k in range(len(at))] == pytest.approx(list(np.quantile(groups["normal"], at)))
    one = lambda held: sorted(map(str, truncated_min_max(rows, "x", "g", held=held).where("x is not null").select("g", F.round("x", 6), F.round("norm", 9)).collect()))
    assert one(40) == one(100_000)
    assert truncated_min_max(rows.where("false"), "x").count() == 0


def test_best_and_bounds_in_one_pass(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-2, 3, (70, 3)).astype(float), np.tile([1.0, 1.0, 1.0], (60, 1))])
    rows = spark.createDataFrame([(f"i{k:03d}", v.tolist()) for k, v in enumerate(x)] + [("none", None)], "item string, v array<double>").repartition(3)
    asked = spark.createDataFrame([(k, x[k].tolist()) for k in range(9)], "query long, v array<double>")
    want, scaled = [], {}
    for q in range(9):
        s = x @ x[q]
        order = sorted(range(len(x)), key=lambda i: (-s[i], i))[:4]
        span = s.max() - s.min()
        scaled[q] = {f"i{i:03d}": 1.0 if span == 0 else (s[i] - s.min()) / span for i in range(len(x))}
        want += [(q, f"i{i:03d}", r, round(scaled[q][f"i{i:03d}"], 9)) for r, i in enumerate(order, 1)]
    for block in (4096, 5):
        got = [(r["query"], r["item"], r["rank"], round(r["score"], 9)) for r in knn.best_normal(asked, rows, 4, block).collect()]
        assert sorted(got) == sorted(want)
        pairs = knn.all_normal(asked, rows, block).collect()
        assert len(pairs) == 9 * len(x) and all(r["score"] == pytest.approx(scaled[r["query"]][r["item"]]) for r in pairs)
    assert knn.best_normal(asked.where("false"), rows, 4).count() == 0 and knn.best_normal(asked, rows.where("false"), 4).count() == 0


def test_threshold_join_prunes_and_loses_nothing(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 8))
    x = np.concatenate([c + 0.12 * rng.standard_normal((25, 8)) for c in centres] + [np.zeros((2, 8)), np.tile(centres[0], (6, 1))])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)], "item long, v array<double>")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = unit @ unit.T
    counted = {}
    for least, block in ((0.8, 100), (0.8, 7), (0.97, 100)):
        got = {(r["query"], r["item"]): r["score"] for r in knn.threshold_pairs(rows.withColumnRenamed("item", "query"), rows, least, block, counted).collect()}
        want = {(int(a), int(b)): s[a, b] for a, b in zip(*np.nonzero(s >= least))}
        assert {k for k in want if want[k] > least + 1e-9} <= set(got) <= {k for k in want if want[k] > least - 1e-9} and all(got[k] == pytest.approx(want[k]) for k in got)
        assert counted["all"] == len(x) ** 2 and counted["made"] < 0.35 * counted["all"]
    assert knn.threshold_pairs(rows.withColumnRenamed("item", "query"), rows.where("false"), 0.8, 7).count() == 0


def test_synonyms_one_after_the_other(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 3))
    name = lambda k: f"name{k}" if k % 7 else f"{k % 10}"
    rows = spark.createDataFrame([(name(k) if k != 13 else " ", v.tolist()) for k, v in enumerate(x)], "entity string, v array<double>").dropDuplicates(["entity"])
    whole = {(r["src"], r["dst"]) for r in G.synonyms(rows, 0.8, most=4).collect()}
    old = rows.where("entity < 'name3'")
    before = Scratch(spark).save(G.synonyms(old, 0.8, most=4), "before")
    more = G.synonyms(rows, 0.8, most=4, new=rows.where("entity >= 'name3'"))
    assert {(r["src"], r["dst"]) for r in G.nearest_sources(before.unionByName(more), 4).collect()} == whole


def test_ranks_with_a_hub_and_what_is_left(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 7)
    rng = np.random.default_rng(9)
    n = 40
    pairs = {(0, k) for k in range(1, n)} | {(k, 0) for k in range(1, n)} | {(int(a), int(b)) for a, b in rng.integers(0, n, (60, 2)) if a != b}
    w = {p: float(rng.uniform(0.1, 2)) for p in sorted(pairs)}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", x) for (a, b), x in w.items()], "src string, dst string, weight double")
    reset = spark.createDataFrame([(q, f"n{k}", float(x)) for q in range(3) for k, x in enumerate(rng.uniform(size=n)) if k % (q + 2) == 0], "query long, node string, r double")
    p = np.zeros((n, n))
    for (a, b), x in w.items():
        p[b, a] = x
    p /= p.sum(axis=0)
    exact = {}
    for q in range(3):
        v = np.zeros(n)
        for r in reset.where(f"query = {q}").collect():
            v[int(r["node"][1:])] = r["r"]
        exact[q] = np.linalg.solve(np.eye(n) - 0.5 * p, 0.5 * v / v.sum())
    for least, rounds in ((1e-9, 64), (1e-3, 64)):
        rows = R.pagerank(spark, edges, reset, least=least, rounds=rounds).collect()
        for q in range(3):
            own = {int(r["node"][1:]): r for r in rows if r["query"] == q}
            left = sum(r["left"] for r in own.values())
            gaps = [exact[q][k] - (own[k]["rank"] if k in own else 0) for k in range(n)]
            assert min(gaps) > -1e-12 and sum(gaps) <= left + 1e-12
            assert left < 1e-6 if least == 1e-9 else left > 0
    # a hub's own weights are dealt in pieces too, and come to what one table of all weights gives
    div = spark.createDataFrame([(f"n{k}", float(x)) for k, x in enumerate(rng.uniform(size=n))], "entity string, norm double")
    rel = spark.createDataFrame([(q, f"n{k}", float(x)) for q in range(3) for k, x in enumerate(rng.uniform(size=n))], "query long, entity string, norm double")
    common = spark.createDataFrame([(f"n{k}", "p", 1.0) for k in range(0, n, 3)] + [("p", f"n{k}", 1.0) for k in range(0, n, 3)], "src string, dst string, weight double")
    pick = edges.select("src", "dst", F.col("weight").alias("prior_norm"))
    for how in ({"loops": False, "down": 0.7, "up": 0.3}, {"directions": False, "prior": True, "by_prior": 0.4, "base": 0.1}):
        keyed = R.pagerank(spark, common, reset, keyed=R.directed_weights(pick, div, rel, **how), least=1e-3)
        parts = R.pagerank(spark, common, reset, own=R.factors(spark, pick, div, rel, **how), least=1e-3)
        a, b = ({(r["query"], r["node"]): r["rank"] for r in df.collect()} for df in (keyed, parts))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_best_by_cells_loses_nothing(spark):
    """Many queries meet only the cells that can hold a best or least product, and equal ones are searched for once."""
    rng = np.random.default_rng(10)
    around = lambda n: np.stack([f(a) for a in rng.uniform(0, 2 * np.pi, (2, n)) for f in (np.cos, np.sin)], axis=1)
    x = np.concatenate([around(1200), np.zeros((2, 4)), 2 * around(3)])
    x[300:320] = x[7]
    q = np.concatenate([x[:300], around(150), np.tile(x[20], (30, 1)), np.zeros((1, 4))])
    items = spark.createDataFrame([(f"i{k:04d}", v.tolist()) for k, v in enumerate(x)] + [("none", None)], "item string, v array<double>").repartition(3)
    asked = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)] + [(999, None)], "query long, v array<double>")
    s = q @ x.T
    span = np.where(np.ptp(s, axis=1) == 0, 1.0, np.ptp(s, axis=1))
    score = np.where(np.ptp(s, axis=1)[:, None] == 0, 1.0, (s - s.min(axis=1)[:, None]) / span[:, None])
    of = lambda df: sorted((r["query"], r["rank"], r["item"], round(r["raw"], 8), round(r["score"], 8)) for r in df.collect())
    for k in (1, 3):
        order = np.lexsort((np.broadcast_to(np.arange(len(x)), s.shape), -s.round(9)), axis=1)[:, :k]
        want = [(j, r + 1, f"i{i:04d}", round(s[j, i], 8) + 0.0, round(score[j, i], 8)) for j in range(len(q)) for r, i in enumerate(order[j])]
        assert of(knn.best_normal(asked, items, k, 100)) == sorted(want)
    few = asked.where("query < 450")
    assert of(knn.best_by_cells(few, items, 1, 100)) == [w for w in of(knn.best_normal(asked, items, 1, 4096)) if w[0] < 450]
    # where cells rule nothing out, or a vector is not finite, all products are made
    assert knn.best_by_cells(asked, items.withColumn("v", F.expr("array(1D, 1D, 0D, 0D)")), 1, 100) is None
    assert knn.best_by_cells(asked, items.withColumn("v", F.expr("if(item = 'i0003', array(1D, double('nan'), 0D, 0D), v)")), 1, 100) is None
