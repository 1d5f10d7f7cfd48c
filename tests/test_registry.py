"""Models by name, strict replies and pooled vectors."""

import pytest
from pyspark.sql import functions as F

from corpusloom.engine import Options
from corpusloom.functions.scores import masked_mean
from corpusloom.models import FunctionLLM, HashingEmbedder, KeepAll, PatternExtractor, PooledEmbedder, ReplyFilter, StrictExtractor
from corpusloom.registry import EMBEDDERS, EXTRACTORS, FILTERS, LLMS, Registry, open_engine


def test_names():
    made = Registry("thing", a=lambda rest: ("a", rest))
    made.add("a/b", lambda rest: ("a/b", rest))
    assert [made.make(n) for n in ("a", "a/c/d", "a/b", "a/b/c", "a/bc")] == [("a", ""), ("a", "c/d"), ("a/b", ""), ("a/b", "c"), ("a", "bc")]
    for wrong in ("", "b", "ab", "A"):
        with pytest.raises(ValueError, match="no thing"):
            made.make(wrong)
    with pytest.raises(ValueError, match="already"):
        made.add("a", None)
    assert EMBEDDERS.make("hashing").dimensions == 64 and EMBEDDERS.make("hashing/7").dimensions == 7
    llm = LLMS.make("first_passage")
    assert isinstance(llm, FunctionLLM) and isinstance(EXTRACTORS.make("strict", llm), StrictExtractor) and EXTRACTORS.make("reply", llm).llm is llm
    assert EXTRACTORS.make("pattern/likes|hates", llm).relations == ("likes", "hates") and isinstance(FILTERS.make("all", llm), KeepAll)
    assert FILTERS.make("reply", llm).most is None and FILTERS.make("reply/4", llm).most == 4


def test_an_engine_of_named_models_goes_on_where_it_was(spark, tmp_path):
    docs = spark.createDataFrame([("Ann lives in Rome.",), ("Rome is part of Italy.",)], "text string")
    first = open_engine(spark, str(tmp_path), options=Options(least=1e-3))
    first.index(docs)
    again = open_engine(spark, str(tmp_path), fact_filter="reply", options=Options(least=1e-3))
    other = open_engine(spark, str(tmp_path), embedder="hashing/16")
    assert again.tables.root == first.tables.root != other.tables.root
    assert again.facts().count() == 2 and other.facts().count() == 0
    assert isinstance(again.fact_filter, ReplyFilter) and isinstance(again.extractor, PatternExtractor) and isinstance(again.embedder, HashingEmbedder)
    asked = spark.createDataFrame([(1, "Where lives Ann?")], "query long, question string")
    assert again.retrieve(asked, 1).first()["rank"] == 1


STRICT = {
    "whole": ('{"named_entities": ["A", " b "]}', '{"triples": [["A", "is", " b "], ["A"]]}', ["A", " b "], [["A", "is", " b "], ["A"]]),
    "empty": ("", "{}", [], []),
    "fenced": ('```json\n{"named_entities": ["A"]}\n```', '{"triples": [["A", "is", "b"]]} as asked', [], []),
    "cut": ('{"named_entities": ["A"', '{"triples": [["A", "is"', [], []),
    "other kinds": ('{"named_entities": [1, null]}', '{"triples": "A"}', [], []),
    "other keys": ('{"entities": ["A"]}', '[["A", "is", "b"]]', [], []),
    "marks inside": ('{"named_entities": ["a\\"]}, {", "\u00e9"]}', '{"triples": []}', ['a"]}, {', "\u00e9"], []),
}


def test_strict_replies(spark):
    script = {k: v[:2] for k, v in STRICT.items()}

    def told(talk):
        key = talk[-1][1].split("\n")[0]
        if key == "fails":
            raise OSError("no model")
        return script[key]["named entities" not in talk[0][1]]

    chunks = spark.createDataFrame([(k, k) for k in [*STRICT, "fails"]] + [("null", None)], "hash_id string, content string")
    chunks = chunks.withColumn("content", F.when(F.col("hash_id") != "null", F.col("content")))
    llm = FunctionLLM(lambda talk: "{}" if talk[-1][1] is None else told(talk))
    got = {r["hash_id"]: r for r in StrictExtractor(llm).extract(chunks).collect()}
    for k, (_, _, entities, triples) in STRICT.items():
        assert (k, got[k]["entities"], got[k]["triples"]) == (k, entities, triples)
    assert all(got[k]["entities"] == got[k]["triples"] == [] for k in ("fails", "null"))
    assert StrictExtractor(llm).extract(chunks.limit(0)).count() == 0


def test_means_of_tokens_that_count(spark):
    rows = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0]), (2, [[1.0, 2.0]], [0]), (3, [], []), (4, None, None), (5, [[5.0, 1.0]], [1])], "k int, v array<array<double>>, n array<int>")
    got = {r["k"]: r["m"] for r in rows.select("k", masked_mean(F.col("v"), F.col("n")).alias("m")).collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 0.0], 3: None, 4: None, 5: [5.0, 1.0]}

    def tokens(texts, told):
        own = [t.split() for t in texts]
        width = max(map(len, own))
        return [[[float(len(w)), 1.0] for w in ws] + [[99.0, 99.0]] * (width - len(ws)) for ws in own], [[1] * len(ws) + [0] * (width - len(ws)) for ws in own]

    texts = spark.createDataFrame([("aa bbbb",), ("c",), (None,)], "t string").coalesce(1)
    plain = PooledEmbedder(tokens, norm=False)
    assert [r[0] for r in texts.where("t is not null").select(plain.passages(F.col("t"))).collect()] == [[3.0, 1.0], [1.0, 1.0]]
    assert all(sum(x * x for x in r[0]) == pytest.approx(1) for r in texts.where("t is not null").select(PooledEmbedder(tokens).query_to_fact(F.col("t"))).collect())
