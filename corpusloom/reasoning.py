"""Answers by steps: each thought of a model is searched for, and what is found goes into the question for the next thought.

All questions take their steps together. A round retrieves for every open question, adds the passages it did not
have, asks once for its next thought, and retires questions that have ended: by an answer, an empty thought or
a failed call (error), a repeated thought, or after the last round. Rounds are written, so no model is called
again by what reads them. Null questions are retired unasked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.templates import NEXT_THOUGHT, Template
from corpusloom.functions.text import strip
from corpusloom.models import LLM, replied
from corpusloom.session import Scratch

#: Fixed value: the words before a final answer.
ANSWER_MARK = "So the answer is:"
STEPS = "query, question, thoughts, answer, ended, rounds"


def shown(passages: Column, grouped: bool) -> Column:
    """Passages as a prompt shows them, in order. grouped puts those of one first line together under it."""
    if not grouped:
        return F.array_join(F.transform(passages, lambda p: F.concat(p["content"], F.lit("\n\n"))), "")
    title = lambda p: F.substring_index(p["content"], "\n", 1)
    rest = lambda p: F.trim(F.substring(p["content"], F.length(title(p)) + 1, F.length(p["content"])), F.lit("\n"))
    titles = F.array_distinct(F.transform(passages, title))
    body = lambda t: F.array_join(F.transform(F.filter(passages, lambda p: title(p) == t), rest), "\n")
    return F.array_join(F.transform(titles, lambda t: F.concat(F.lit("Wikipedia Title: "), t, F.lit("\n"), body(t), F.lit("\n\n"))), "")


def reason(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], llm: LLM, rounds: int = 4, most_passages: int = 15, template: Template = NEXT_THOUGHT, grouped: bool = False) -> tuple[DataFrame, DataFrame]:
    """questions(query, question), retrieve: (query, question) -> (query, rank, chunk, score, content).

    Returns (query, question, thoughts, answer, ended, rounds), ended being answer, error, repeat or rounds, and
    (query, chunk, content, score, round): every passage found, with its best score and the round it came in.
    A prompt shows the first most_passages of a question, those found earlier first.
    """
    spark, scratch = questions.sparkSession, Scratch(questions.sparkSession)
    none = F.lit(None).cast("string")
    state = questions.select("query", "question", F.array().cast("array<string>").alias("thoughts"), none.alias("answer"), F.when(F.col("question").isNull(), "error").alias("ended"), F.lit(0).alias("rounds"))
    state = scratch.save(state, "state-0")
    found = spark.createDataFrame([], questions.select("query").schema).withColumns({"chunk": none, "content": none, "score": F.lit(0.0), "round": F.lit(0), "rank": F.lit(0).cast("long")})
    for turn in range(1, rounds + 1):
        open_now = state.where("ended is null")
        if open_now.isEmpty():
            break
        sought = open_now.select("query", F.coalesce(F.try_element_at("thoughts", F.lit(-1)), "question").alias("question"))
        new = retrieve(sought).select("query", "chunk", "content", "score", F.lit(turn).alias("round"), F.col("rank").cast("long").alias("rank"))
        first = F.struct("round", "rank")
        both = found.unionByName(new).groupBy("query", "chunk").agg(F.first("content").alias("content"), F.max("score").alias("score"), F.min(first).alias("at"))
        found = scratch.save(both.select("query", "chunk", "content", "score", "at.round", "at.rank"), f"found-{turn}")
        listed = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("round", "rank", "chunk", "content"))), 1, most_passages).alias("passages"))
        asked = open_now.join(listed, "query", "left").withColumn("passages", F.coalesce("passages", F.array().cast(listed.schema["passages"].dataType)))
        prompt = template.render(passages=shown(F.col("passages"), grouped), question=F.col("question"), thoughts=F.array_join(F.transform("thoughts", lambda t: F.concat(F.lit(" "), t)), ""))
        told = replied(llm, asked.withColumn("_prompt", prompt).drop("passages"), F.col("_prompt"), "reply").drop("_prompt")
        thought, parts = strip(F.coalesce("reply.message", F.lit(""))), F.split(F.col("_thought"), ANSWER_MARK)
        ended = F.when(F.col("reply.error").isNotNull() | (F.col("_thought") == ""), "error").when(F.size(parts) > 1, "answer").when(F.array_contains("thoughts", F.col("_thought")), "repeat").when(F.lit(turn == rounds), "rounds")
        stepped = told.withColumn("_thought", thought).select("query", "question", F.when(ended.isin("error", "repeat"), F.col("thoughts")).otherwise(F.concat("thoughts", F.array("_thought"))).alias("thoughts"), F.when(ended == "answer", F.rtrim(strip(F.element_at(parts, -1)), F.lit("."))).alias("answer"), ended.alias("ended"), F.lit(turn).alias("rounds"))
        state = scratch.save(state.where("ended is not null").unionByName(stepped), f"state-{turn}")
    return state, found.select("query", "chunk", "content", "score", "round")
