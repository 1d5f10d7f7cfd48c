"""What larger tables showed: cuts, quadratic work on equal or zero vectors, memory of block products."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.operators import knn, passages
from corpusloom.operators import retrieval as R
from corpusloom.engine import Engine
from corpusloom.operators import blocks
from corpusloom.operators.blocks import ranks_in_blocks
from corpusloom.operators.ranks import ranks
from corpusloom.plans import catalogue, lifecycle
from corpusloom.sources.tables import Transaction


def test_all_synonyms_of_an_entity_with_many(spark):
    rows = spark.createDataFrame([(f"name {k:03d}", [1.0, 0.001 * k]) for k in range(130)], "entity string, v array<double>")
    got = G.synonyms(rows, 0.5, most=None).groupBy("src").count().collect()
    assert len(got) == 130 and {r["count"] for r in got} == {129}


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    x = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]]
    rows = spark.createDataFrame([(f"name {k:03d}", x[k % 3]) for k in range(90)], "entity string, v array<double>")
    met = []
    plain = knn.threshold_pairs
    monkeypatch.setattr(G, "threshold_pairs", lambda q, i, least: met.append((q.count(), i.count())) or plain(q, i, least))
    got = {(r["src"], r["dst"]): r["weight"] for r in G.synonyms(rows, 0.8, most=40).collect()}
    assert met == [(3, 3)]
    cosine = lambda a, b: np.dot(x[a % 3], x[b % 3]) / np.linalg.norm(x[a % 3]) / np.linalg.norm(x[b % 3])
    for a in range(90):
        near = sorted((b for b in range(90) if b != a and cosine(a, b) >= 0.8), key=lambda b: (-round(cosine(a, b), 9), b))[:40]
        assert {b for b in range(90) if (f"name {a:03d}", f"name {b:03d}") in got} == set(near)


def test_zero_vectors_meet_nothing(spark):
    rows = spark.createDataFrame([(k, [0.0, 0.0] if k > 4 else [1.0, 0.1 * k]) for k in range(60)], "item long, v array<double>")
    counted = {}
    got = knn.threshold_pairs(rows.withColumnRenamed("item", "query"), rows, 0.5, 7, counted).collect()
    assert {(r["query"], r["item"]) for r in got} == {(a, b) for a in range(5) for b in range(5)} and counted["made"] == 25
    zero = rows.where("item > 4")
    assert knn.threshold_pairs(zero.withColumnRenamed("item", "query"), zero, 0.5, 7).isEmpty()


@pytest.mark.parametrize("how", [{}, {"loops": False, "down": 0.7, "up": 0.3}, {"directions": False, "prior": True, "by_prior": 0.4, "base": 0.1}])
def test_ranks_leave_nothing_small_out(spark, how):
    """Rank far below 1e-7 is passed on too; a graph beyond the bound goes round by round and comes to the same."""
    rng = np.random.default_rng(3)
    edges = [(f"n{a}", f"n{b}", 1.0) for a, b in {tuple(map(int, p)) for p in rng.integers(0, 12, (40, 2))} if a != b] + [("n0", "far", 1e-9)]
    edges = spark.createDataFrame(edges, "src string, dst string, weight double")
    reset = spark.createDataFrame([(q, f"n{k}", float(x)) for q in range(2) for k, x in enumerate(rng.uniform(size=12)) if (k + q) % 3] + [(0, "n1", None), (1, "n2", -1.0)], "query long, node string, r double")
    own = None
    if how:
        common = spark.createDataFrame([(f"n{k}", "p", 1.0) for k in range(0, 12, 3)] + [("p", f"n{k}", 1.0) for k in range(0, 12, 3)] + [("n0", "far", 1e-9), ("far", "n0", 1.0)], "src string, dst string, weight double")
        div = spark.createDataFrame([(f"n{k}", float(x)) for k, x in enumerate(rng.uniform(size=12))], "entity string, norm double")
        rel = spark.createDataFrame([(q, f"n{k}", float(x)) for q in range(2) for k, x in enumerate(rng.uniform(size=12))], "query long, entity string, norm double")
        own = R.factors(spark, edges.select("src", "dst", F.col("weight").alias("prior_norm")), div, rel, **how)
        edges = common
    at = lambda df: {(r["query"], r["node"]): r["rank"] for r in df.collect()}
    near, far = (at(ranks(spark, edges, reset, own=own, held=held)) for held in (None, 0))
    assert near.keys() == far.keys() and all(near[k] == pytest.approx(far[k], abs=1e-12) for k in near)
    assert 0 < near[0, "far"] < 1e-7
    names = spark.createDataFrame([("far",), ("n1",), ("n5",), ("p",)], "node string")
    few = at(ranks(spark, edges, reset, own=own, best=2, among=names))
    assert few == {k: pytest.approx(near[k]) for q in range(2) for k in sorted((k for k in near if k[0] == q and k[1] in ("far", "n1", "n5", "p")), key=lambda k: -near[k])[:2]}


def test_block_products_come_in_pieces():
    rng = np.random.default_rng(5)
    q, v = rng.standard_normal((300, 4)), rng.standard_normal((2000, 4))
    items = pd.DataFrame({"item": range(2000), "v": list(v)})
    frames = list(knn.added(knn.Pairs(np.arange(300)), q, items, False))
    assert max(map(len, frames)) <= knn.CELLS < 300 * 2000 == sum(map(len, frames))
    both = pd.concat(frames).sort_values(["query", "item"])
    assert np.allclose(both["score"].to_numpy().reshape(300, 2000), q @ v.T)


def test_an_index_never_broadcasts_tables_that_grow(spark, tmp_path, monkeypatch):
    """Synonyms, mentions and edges are small as files and large as a driver's hash tables."""
    plans, stage = {}, Transaction._stage

    def noted(self, kind, name, rows):
        plans[name] = rows._jdf.queryExecution().sparkPlan().toString()
        return stage(self, kind, name, rows)

    monkeypatch.setattr(Transaction, "_stage", noted)
    Engine(spark, str(tmp_path)).index(spark.createDataFrame([("Ann lives in Oslo. Bob lives in Oslo.",)], "text string"))
    assert {name for name in ("mentions", "edges") if "BroadcastHashJoin" in plans[name]} == set()


def test_ranks_in_blocks(spark, monkeypatch):
    """Blocks of few edges, lots of few queries and sums in pieces give the ranks of the whole graph, nodes without an edge out included."""
    rng = np.random.default_rng(5)
    edges = [(f"n{a}", f"n{b}", float(w)) for (a, b), w in zip({tuple(map(int, p)) for p in rng.integers(0, 14, (60, 2))}, rng.uniform(size=60)) if a != b and a != 3] + [("n0", f"m{k}", 1.0) for k in range(9)]
    edges = spark.createDataFrame(edges, "src string, dst string, weight double")
    reset = spark.createDataFrame([(q, f"n{k}", float(x)) for q in range(5) for k, x in enumerate(rng.uniform(size=14)) if (k + q) % 3] + [(0, "alone", 0.5), (1, "n2", None)], "query long, node string, r double")
    at = lambda df: {(r["query"], r["node"]): r["rank"] for r in df.collect()}
    want = at(ranks(spark, edges, reset, rounds=40))
    monkeypatch.setattr(blocks, "LOT", 2)
    monkeypatch.setattr(blocks, "CELLS", 6)
    got = at(ranks_in_blocks(spark, edges, reset, rounds=40, least=0.0, per=10))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    src, seg, share, x = rng.integers(0, 5, 30), np.sort(np.r_[np.arange(8), rng.integers(0, 8, 22)]), rng.uniform(size=30), rng.uniform(size=(5, 2))
    assert np.allclose(blocks.sums(x, src, seg, share), [(x[src[seg == k]] * share[seg == k, None]).sum(axis=0) for k in range(8)])
    monkeypatch.setattr(blocks, "LOTS", 2)
    assert ranks_in_blocks(spark, edges, reset, per=10) is None


def test_what_is_left_is_not_counted_as_rank(spark):
    """Ranks are too small by at most what is left; only with whole do they hold all of it."""
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    reset = spark.createDataFrame([(1, "a", 1.0)], "query long, node string, r double")
    part, whole = (R.pagerank(spark, edges, reset, rounds=3, whole=w).agg(F.sum("rank"), F.sum("left")).first() for w in (False, True))
    assert part[0] + part[1] == pytest.approx(1.0) and part[1] > 0.01 and whole[0] == pytest.approx(1.0)


def test_ranks_among_entities_score_no_passage(spark, monkeypatch):
    """Seeds of the undirected ranks among entities come from facts alone; no row for a query and a passage is made."""
    asked = []
    monkeypatch.setattr(catalogue, "passages_of", lambda *a: asked.append(a))
    assert not lifecycle.entity_only_of(spark, "/root/testdata/sf0.001", False).isEmpty() and not asked


def test_best_passages_without_a_row_for_every_pair(spark, monkeypatch):
    """Passages folded into their entities come to what ranks of the whole graph are, in one group of queries or in many."""
    rng = np.random.default_rng(12)
    n, k, asked = 60, 9, 7
    v = rng.integers(-2, 3, (n, 3)).astype(float)
    v[40:44] = v[3]
    ends = [sorted({int(e) for e in rng.integers(0, k, 1 + c % 3)}) for c in range(n)]
    ends[0] = list(range(k))
    items = spark.createDataFrame([(f"c{c:02d}", None if c == 11 else v[c].tolist()) for c in range(n)], "chunk string, v array<double>").repartition(3)
    mentioned = spark.createDataFrame([(f"e{e}", f"c{c:02d}") for c in range(n) for e in ends[c]], "entity string, chunk string")
    edges = spark.createDataFrame([(f"e{a}", f"e{b}", float(w)) for a, b, w in {(int(a), int(b)): (int(a), int(b), w) for a, b, w in rng.integers(1, k, (20, 3)) if a != b}.values()] + [("e1", "e2", float("nan")), ("e2", "e0", 0.0)], "src string, dst string, weight double")
    questions = spark.createDataFrame([(q, [0.0, 0.0, 0.0] if q == 6 else v[q].tolist()) for q in range(asked)] + [(99, None)], "query long, qv array<double>")
    seeds = spark.createDataFrame([(q, f"e{(q * 5 + j) % k}", 0.3 * j + 0.1) for q in range(asked - 2) for j in range(3)] + [(0, "e1", None), (1, "e1", -2.0), (2, "e3", 0.25)], "query long, node string, r double")
    prior = R.scored_normal(questions, items, "chunk").select("query", F.col("chunk").alias("node"), (0.08 * F.col("score")).alias("r"))
    both = edges.unionByName(G.passage_edges(mentioned))
    of = lambda df: sorted((r["query"], r["node"], round(r["rank"], 10)) for r in df.collect())
    for rounds in (1, 24):
        want = of(ranks(spark, both, seeds.unionByName(prior), rounds=rounds, best=5, among=items.select(F.col("chunk").alias("node"))))
        assert len(want) == 5 * asked
        for bound in (None, 1):
            assert of(passages.best_passages(spark, edges, mentioned, seeds, questions, items, 0.08, 5, rounds=rounds, ranks=bound)) == want
    found = lambda **how: passages.best_passages(spark, *[how.get(c, d) for c, d in (("edges", edges), ("mentioned", mentioned), ("seeds", seeds), ("questions", questions), ("items", items))], 0.08, 5, held=how.get("held"))
    assert found(held=8) is None and found(items=items.union(items.limit(1))) is None and found(mentioned=mentioned.where("chunk <> 'c05'")) is None
    assert found(items=items.withColumn("v", F.expr("if(chunk = 'c07', array(1D, double('nan'), 0D), v)"))) is None

    def never(*a):
        raise AssertionError("a row for every query and passage")

    monkeypatch.setattr(catalogue, "passages_of", never)
    assert catalogue.graph_retrieval(spark, "/root/testdata/sf0.001").count() == 100
