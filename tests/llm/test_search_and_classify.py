"""Nearest neighbours against brute force; the classifier's held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import neighbours
from corpusloom.llm.neighbours import Tree, nearest
from corpusloom.llm.quality_knn import classify, term_counts, train
from corpusloom.llm.textbytes import Texts
from corpusloom.session import Scratch
from tests.llm.helpers import LONG, ODD, parquet, table


def brute_force(rows, k):
    """Per query the k best (score, vec_id)."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, v in zip(ids, x):
        if i % 50 == 0:
            s = x @ v
            out[i] = [(j, s[n]) for n, j in sorted(((n, j) for n, j in enumerate(ids) if j != i), key=lambda c: (-s[c[0]], c[1]))[:k]]
    return out


def test_recall_and_scores(spark):
    rows = parquet(spark, "embeddings", "0.1")
    want = brute_force([(r["vec_id"], r["embedding"]) for r in rows.collect()], 5)
    got = {}
    for r in nearest(spark, rows, Scratch(spark), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == [1, 2, 3, 4, 5] and all(i != q for _, i, _ in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits += len({i for i, _ in near} & {i for _, i, _ in mine})
    assert hits >= 0.9 * 5 * len(want)


def test_descent_goes_on_until_the_lists_settle(spark):
    x = np.random.default_rng(5).standard_normal((6000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = {q: {i for i, _ in near} for q, near in brute_force(list(enumerate(x)), 5).items()}
    # two trees of small leaves are a poor start, and a narrow beam does not make up for poor lists
    found = nearest(spark, rows, Scratch(spark), F.col("vec_id") % 50 == 0, trees=2, leaf=12, beam=12, neighbours=12, reverse=6, expanded=4).collect()
    assert sum(r["vec_id"] in want[r["query_id"]] for r in found) >= 0.75 * 5 * len(want)


@pytest.mark.parametrize("offset", [0.0, 4.0])
def test_recall_comes_from_the_descent(spark, offset):
    """Also where all vectors have a common part. A narrow beam does not make up for a graph that was never improved."""
    x = np.random.default_rng(7).standard_normal((3000, 24)) + offset
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = {q: {i for i, _ in near} for q, near in brute_force(list(enumerate(x)), 5).items()}
    share = {}
    for descents in (None, 0):
        found = nearest(spark, rows, Scratch(spark), F.col("vec_id") % 50 == 0, trees=3, beam=12, expanded=4, descents=descents).collect()
        share[descents] = sum(r["vec_id"] in want[r["query_id"]] for r in found) / (5 * len(want))
    assert share[None] >= 0.95 and share[0] < 0.85, share


def test_shuffled_vectors_give_what_broadcast_ones_give(spark, monkeypatch):
    rows = parquet(spark, "embeddings", "0.01")
    narrow = dict(trees=2, leaf=16, beam=12, neighbours=8, reverse=4, expanded=4)
    search = lambda: sorted(tuple(r) for r in nearest(spark, rows, Scratch(spark), F.col("vec_id") % 50 == 0, **narrow).collect())
    want = search()
    monkeypatch.setattr(neighbours, "CODES", 0)
    monkeypatch.setattr(neighbours, "VECTORS", 0)
    monkeypatch.setattr(neighbours, "small", lambda df, rows, limit=0: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert search() == want and want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_leaves_are_small_wherever_the_vectors_lie():
    x = (np.random.default_rng(2).standard_normal((20_000, 16)) + 5).astype(np.float32)
    for depth, sample in ((9, x[:4000]), (9, x[:300])):
        sizes = np.bincount(Tree(sample, depth, np.random.default_rng(1)).cell(x))
        assert len(sizes) <= 512 and np.percentile(np.repeat(sizes, sizes), 99) <= 20 * 20_000 / 512


def test_vectors_that_take_no_part_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, -1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, []), (2, [1.0, 1.0]), (50, [0.0, 0.0]), (100, None)]
    df = spark.createDataFrame([(i, v, 1, 1, 1.0) for i, v in rows], "vec_id long, embedding array<double>, node int, q int, sim double")
    got = [tuple(r) for r in nearest(spark, df, Scratch(spark), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert [g[3] for g in got] == pytest.approx([1, 0.5**0.5, 0.5**0.5])
    assert nearest(spark, df.where("false"), Scratch(spark), F.col("vec_id") % 50 == 0).count() == 0


def test_many_copies_of_a_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(300 + i, [1.0, float(i % 7), 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(spark, df, Scratch(spark), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q, want in brute_force(rows, 5).items():
        if q < 300:
            assert sorted(got[q]) == [i for i in range(7) if i != q][:5]


def test_held_out_accuracy(spark):
    docs, labels = parquet(spark, "documents", "0.1"), parquet(spark, "labels", "0.1")
    found = classify(spark, docs, train(spark, docs, labels))
    scored = found.where("held_out").join(labels.where("quality is not null"), "doc_id").select("quality", "score", "predicted").toPandas()
    good, bad = scored[scored["quality"] == 1]["score"].to_numpy(), scored[scored["quality"] == 0]["score"].to_numpy()
    auc = ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()) if len(good) and len(bad) else 0
    accuracy = (scored["quality"] == scored["predicted"]).mean()
    print(f"held out: {len(scored)} rows, area under the curve {auc:.4f}, accuracy {accuracy:.4f}")
    assert auc >= 0.9 and accuracy >= 0.9
    assert (scored[scored["quality"] == 1]["predicted"] == 1).mean() >= 0.97


def test_votes_are_those_of_all_cosines(spark):
    """Each text's vote worked out alone, row by row; copies in the sample tie, and all of them have a vote."""
    docs, labels = parquet(spark, "documents"), parquet(spark, "labels")
    copies = docs.where("doc_id < 8").crossJoin(spark.range(1, 31)).withColumn("doc_id", F.col("doc_id") + 10**6 * F.col("id")).drop("id")
    docs = docs.unionByName(copies).unionByName(docs.where("doc_id = 1").withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(-1).cast(docs.schema["doc_id"].dataType)))
    labels = labels.select("doc_id", "quality").unionByName(copies.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality")))
    model = train(spark, docs, labels)
    assert len(model.labels) > 100 and 0 < model.labels.mean() < 1
    found = {r["doc_id"]: r["score"] for r in classify(spark, docs, model).collect()}
    prior = model.labels.mean()
    weigh = [1 if good else max(1.0, prior / (1 - prior)) for good in model.labels]
    for r in docs.select("doc_id", "text").collect():
        (own,) = model.latent(term_counts(Texts([r["text"]])))
        sims = [sum(a * b for a, b in zip(own.tolist(), v)) for v in model.vectors.tolist()]
        last = sorted(sims, reverse=True)[model.neighbours - 1]
        votes = [(max(0, c) ** 4 * w, good) for c, w, good in zip(sims, weigh, model.labels) if c >= last - 1e-5]
        total = sum(v for v, _ in votes)
        want = sum(v * good for v, good in votes) / total if total > 1e-9 else prior
        assert found[r["doc_id"]] == pytest.approx(want, abs=1e-4), r["doc_id"]


def test_classifier_edges(spark):
    docs = table(spark, ODD + [(11, LONG)])
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1), (8, 1), (8, 1)], "doc_id long, quality int")
    for known in (labels, labels.where("false")):
        rows = classify(spark, docs, train(spark, docs, known)).collect()
        assert len(rows) == len(ODD) + 1 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
        if known is not labels:
            assert {r["score"] for r in rows} == {0.5}
    assert classify(spark, docs.where("false"), train(spark, docs, labels)).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = parquet(spark, "documents"), parquet(spark, "labels")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, classify(spark, docs, train(spark, docs, x)).collect())) for x in (labels, turned))
    assert a == b
