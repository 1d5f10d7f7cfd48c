"""A worked example, the life cycle of an index, parsers, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.engine import Engine, Options
from corpusloom.functions import parsing
from corpusloom.functions.scores import truncated_min_max
from corpusloom.functions.text import extracted_answer, normalize_answer, strip, unicode_decoded
from corpusloom.models import FunctionLLM, ReplyExtractor, ReplyFilter
from corpusloom.operators import graph as G
from corpusloom.operators import retrieval as R
from corpusloom.operators.evaluation import at_cuts
from corpusloom.operators.knn import nearest
from corpusloom.session import Scratch
from corpusloom.streaming.incremental import index_stream

MENTIONS = [("A", "p1"), ("A", "p2"), ("A", "p3"), ("B", "p1"), ("C", "p2"), ("C", "p3"), ("D", "p3")]
PAIRS = [("A", "B"), ("A", "C"), ("A", "D"), ("C", "D")]


def example(spark):
    mentioned = spark.createDataFrame(MENTIONS, "entity string, chunk string")
    vectors = spark.createDataFrame([("p1", [1.0, 0.0]), ("p2", [0.0, 1.0]), ("p3", [0.6, 0.8])], "chunk string, v array<double>")
    edges = spark.createDataFrame([e for a, b in PAIRS for e in ((a, b), (b, a))], "src string, dst string")
    queries = spark.createDataFrame([(0, [0.8, 0.6])], "query long, qv array<double>")
    passages = R.scored(queries, vectors, "chunk")
    reset = spark.createDataFrame([(0, "A", 0.5), (0, "B", 0.25), (0, "D", float("nan")), (0, "C", -1.0)], "query long, node string, r double")
    prior = R.min_max(passages, "raw", "query").select("query", F.col("chunk").alias("node"), (0.08 * F.col("score")).alias("r"))
    return mentioned, vectors, edges, passages, reset.unionByName(prior)


def test_worked_example(spark):
    mentioned, vectors, edges, passages, reset = example(spark)
    spread = truncated_min_max(G.diversity(mentioned, vectors), "diversity")
    rel = truncated_min_max(R.relevance(mentioned, passages), "relevance", "query")
    assert {r["entity"]: r["norm"] for r in spread.collect()} == pytest.approx({"A": 1, "B": 0, "C": 0.2874481, "D": 0}, abs=1e-6)
    own = R.directed_weights(edges, spread, rel)
    weights = {r["src"] + r["dst"]: r["weight"] for r in own.collect()}
    assert weights == pytest.approx({"AB": 3.48e-6, "AC": 0.99999304, "AD": 3.48e-6, "BA": 0.1, "CA": 0.1, "CD": 0.9, "DA": 1.4e-7, "DC": 0.09999986, "BB": 0.9, "DD": 0.9}, abs=1e-7)
    ranks = R.pagerank(spark, G.passage_edges(mentioned), reset, keyed=own, least=1e-8)
    want = {"A": 0.35787598, "B": 0.225242, "C": 0.0791435, "D": 0.03974966, "p1": 0.12645796, "p2": 0.05792508, "p3": 0.11360582}
    assert {r["node"]: r["rank"] for r in ranks.collect()} == pytest.approx(want, abs=1e-7)
    parts = R.factors(spark, edges, spread, rel)
    ranks = R.pagerank(spark, G.passage_edges(mentioned), reset, own=parts, least=1e-8)
    assert {r["node"]: r["rank"] for r in ranks.collect()} == pytest.approx(want, abs=1e-7)
    plain = edges.withColumn("weight", F.when(F.col("src").isin("A", "B") & F.col("dst").isin("A", "B"), 2.0).otherwise(1.0))
    ranks = R.pagerank(spark, plain.unionByName(G.passage_edges(mentioned)), reset, least=1e-8)
    want = {"A": 0.4275605, "B": 0.22749519, "C": 0.06480514, "D": 0.05421053, "p1": 0.09386886, "p2": 0.03864068, "p3": 0.0934191}
    assert {r["node"]: r["rank"] for r in ranks.collect()} == pytest.approx(want, abs=1e-7)
    # without loops, a source without downward edges gives its whole budget up; entities without passages have relevance 0
    free = {r["src"] + r["dst"]: r["weight"] for r in R.directed_weights(edges, spread, rel, loops=False).collect()}
    assert free["BA"] == pytest.approx(1) and "BB" not in free
    more = R.relevance(mentioned, passages, spark.createDataFrame([("A",), ("Z",)], "entity string")).where("entity = 'Z'").collect()
    assert [(r["query"], r["relevance"]) for r in more] == [(0, 0.0)]


def test_nodes_without_an_edge_out_give_their_rank_back(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "d", float("nan"))], "src string, dst string, weight double")
    reset = spark.createDataFrame([(0, "a", 1.0), (0, "b", 1.0), (1, "b", 2.0)], "query long, node string, r double")
    got = {(r["query"], r["node"]): r["rank"] for r in R.pagerank(spark, edges, reset).collect()}
    p = np.array([[0, 0, 0], [0.25, 0, 0], [0.75, 1, 0]])
    for q, r in ((0, np.array([0.5, 0.5, 0])), (1, np.array([0, 1.0, 0]))):
        x = r
        for _ in range(60):
            x = 0.5 * r + 0.5 * (p @ x) + 0.5 * x[2] * r
        assert [got.get((q, n), 0) for n in "abc"] == pytest.approx(list(x), abs=1e-6)


def test_blocks_of_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "item long, v array<double>")
    asked = rows.select(F.col("item").alias("query"), "v")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(i)) for q, s in enumerate(unit @ unit.T) for i in np.argsort(-s)[:4]}
    for block in (7, 4096):
        assert {(r["query"], r["item"]) for r in nearest(asked, rows, 4, unit_length=True, block=block).collect()} == want
    assert nearest(asked.where("false"), rows, 4).count() == 0


DOCS = ["Ada Moss is based in Norvik. Norvik is part of Talland.", "Bel Orr lives in Norvik.", "Talland is part of Estmark.", "Cy Finn works for Blue Mill. Blue Mill is located in Harrow.", None, "Bel Orr lives in Norvik.", "No facts here"]
NEW = ["Harrow is part of Estmark.", "Bel Orr lives in Norvik!"]


def test_life_cycle(spark):
    docs = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    queries = spark.createDataFrame([(0, "Where does Bel Orr live?"), (1, "Which land holds Norvik?"), (2, "Where does Bel Orr live?")], "query long, question string")
    state = lambda e: {n: sorted(map(str, e.tables.read(n).collect())) for n in ("chunks", "entities", "facts", "extractions", "nodes", "edges", "triples", "mentions")}
    root = Scratch(spark).path("life")
    engine = Engine(spark, root, options=Options(least=1e-4))
    engine.index(docs([]))
    engine.index(docs(DOCS))
    first = state(engine)
    assert len(first["chunks"]) == 5 and len(first["facts"]) == 6
    engine.index(docs(DOCS[:3]))
    assert state(engine) == first and not engine.repair()
    found = engine.retrieve(queries, 3).collect()
    assert {r["query"]: r["content"] for r in found if r["rank"] == 1}[0] == "Bel Orr lives in Norvik." and len(found) == 9
    assert sorted((r["rank"], r["chunk"]) for r in found if r["query"] == 0) == sorted((r["rank"], r["chunk"]) for r in found if r["query"] == 2)
    again = Engine(spark, root, options=Options(least=1e-4))
    again.index(docs(NEW))
    assert again.chunks().count() == 7
    counts = again.delete(docs([*NEW, "unknown"])).first()
    assert (counts["chunks"], counts["facts"], counts["entities"]) == (2, 1, 0)
    left = state(again)
    assert {k: v for k, v in left.items() if k != "edges"} == {k: v for k, v in first.items() if k != "edges"}
    out = again.rag_qa(queries, spark.createDataFrame([(0, DOCS[1]), (1, DOCS[0])], "query long, text string"), spark.createDataFrame([(0, 0, "Bel Orr lives in Norvik")], "query long, pos int, gold string"))
    assert out["qa"].first()["exact_match"] == 1.0 and {r["k"]: r["recall"] for r in out["retrieval"].collect()}[5] == 1.0
    # no fact is picked: dense ranks for all
    refused = Engine(spark, root, fact_filter=ReplyFilter(FunctionLLM(lambda talk: "I can't say")))
    shown = lambda df: sorted((r["query"], r["rank"], r["chunk"], round(r["score"], 9)) for r in df.collect())
    assert shown(refused.retrieve(queries, 3)) == shown(refused.retrieve_dense(queries, 3))


def test_stream(spark, tmp_path):
    source = tmp_path / "docs"
    spark.createDataFrame([(t,) for t in DOCS[:2]], "text string").write.json(str(source))
    engine = Engine(spark, Scratch(spark).path("stream"))
    for _ in range(2):
        index_stream(engine, spark.readStream.schema("text string").json(str(source)), str(tmp_path / "check")).awaitTermination(120)
        assert engine.chunks().count() == 2


def test_extraction_by_replies_and_long_prompts(spark):
    def reply(talk):
        if "named entities" in talk[0][1]:
            return "```json\n{'entities': ['Ada', ' Norvik ', None]}\n```"
        return '{"triples": [["Ada", "lives in", "Norvik"], ["x"]]} and more'

    chunks = spark.createDataFrame([("c1", "Ada lives in Norvik.")], "hash_id string, content string")
    row = ReplyExtractor(FunctionLLM(reply)).extract(chunks).first()
    assert row["entities"] == ["Ada", "Norvik"] and row["triples"] == [["Ada", "lives in", "Norvik"]] and row["reason"] == ""

    def limited(talk):
        if len(talk[-1][1]) > 900:
            raise ValueError("This model's maximum context length is exceeded")
        return f"Answer: {len(talk[-1][1])}"

    engine = Engine(spark, Scratch(spark).path("qa"), llm=FunctionLLM(limited))
    queries = spark.createDataFrame([(0, "q"), (1, "r")], "query long, question string")
    found = spark.createDataFrame([(0, 1, "a" * 5000), (1, 1, "b")], "query long, rank long, content string")
    answers = {r["query"]: r for r in engine.qa(queries, found).collect()}
    assert answers[0]["error"] is None and int(answers[0]["answer"]) <= 900 and int(answers[1]["answer"]) < 60


def test_parsers():
    assert parsing.repaired('{"a": [1, 2, {"b": "x, y') == '{"a": [1, 2]}' or parsing.repaired('{"a": [1, 2, 3') == '{"a": [1, 2]}'
    assert parsing.repaired('{"a": 1}') == '{"a": 1}'
    assert parsing.keyed_value('text {"x": 1} then {"Triples": [["a", "b", "c"]]}', parsing.TRIPLE_KEYS) == [["a", "b", "c"]]
    assert parsing.keyed_value("nothing", parsing.TRIPLE_KEYS) == []
    assert parsing.filtered_facts("[[ ## fact_after_filter ## ]]\n{'fact': [['a', 'b', 'c'], ['d']]}\n[[ ## completed ## ]]") == [["a", "b", "c"]]
    assert parsing.filtered_facts('so ["a", "b", "c"]] it is') == [["a", "b", "c"]]
    assert parsing.filtered_facts("no") == []
    assert parsing.nearest_fact(["ada", "lives", "norvik"], [("x", "y", "z"), ("ada", "lives in", "norvik")]) == 1
    assert parsing.nearest_fact(["a", "b", "c"], []) is None


def test_odd_texts(spark):
    odd = [" \x1c The  cat,\ta\nan éthe—the end　", None, "", "Answer:\n42\n", "a the an"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(strip(F.col("t")).alias("s"), normalize_answer(F.col("t")).alias("n"), extracted_answer(F.col("t")).alias("a"), unicode_decoded("t").alias("u")).collect()
    assert [r["s"] for r in rows] == [None if t is None else t.strip() for t in odd]
    assert [r["n"] for r in rows] == ["cat éthe— end", None, "", "answer 42", ""]
    assert rows[3]["a"] == "42" and rows[2]["a"] == "" and rows[1]["u"] is None


def test_precision_counts_what_was_retrieved(spark):
    ranking = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "a")], "query long, rank long, chunk string")
    gold = spark.createDataFrame([(0, "a"), (0, "z"), (1, "a")], "query long, chunk string")
    got = {(r["query"], r["k"]): (r["recall"], r["precision"]) for r in at_cuts(ranking, gold, (1, 5)).collect()}
    assert got == {(0, 1): (0.5, 1.0), (0, 5): (0.5, pytest.approx(1 / 3)), (1, 1): (0.0, 0.0), (1, 5): (0.0, 0.0)}
