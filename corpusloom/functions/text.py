"""Scalar text functions of the retrieval engine as column expressions. Null texts stay null."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space as Python's str.strip and str.split see it, ASCII punctuation, and what errors of too long prompts say.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TOO_LONG = ("maximum context length", "context length", "reduce the length of the input prompt", "input tokens")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def content_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(text))


def text_processing(text: Column) -> Column:
    """Lower case, everything but ASCII letters, digits and blanks to blanks, trimmed; inner runs of blanks stay."""
    return F.trim(F.regexp_replace(F.lower(text), "[^A-Za-z0-9 ]", " "))


def normalize_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation and articles, words one blank apart."""
    plain = F.translate(F.lower(text), PUNCTUATION, "")
    plain = F.regexp_replace(plain, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    return F.array_join(F.filter(F.split(plain, f"[{SPACES}]"), lambda w: w != ""), " ")


def extracted_answer(response: Column) -> Column:
    """The text between the first and the second 'Answer:', else the whole response."""
    return F.coalesce(strip(F.get(F.split(response, "Answer:"), F.lit(1))), response)


def qa_prompt(passages: Column, question: Column, k: int, most: int | None = None) -> Column:
    """The first k passages, each cut to most characters where that is given, and the question."""
    cut = (lambda p: F.rtrim(F.substring(p, 1, most))) if most else (lambda p: p)
    shown = F.transform(F.slice(passages, 1, k), lambda p: F.concat(F.lit("Wikipedia Title: "), cut(p), F.lit("\n\n")))
    return F.concat(F.array_join(shown, ""), F.lit("Question: "), question, F.lit("\nThought: "))


def embedding_text(text: Column) -> Column:
    """A text as embedders take it: one line, never empty."""
    plain = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(plain == "", " ").otherwise(plain)


def too_long(message: Column) -> Column:
    """Whether an error message says that a prompt has too many tokens."""
    said = F.lower(F.coalesce(message, F.lit("")))
    return F.greatest(*[F.contains(said, F.lit(part)) for part in TOO_LONG])


def merged_by_first_line(docs: DataFrame, prefix: str = "Wikipedia Title: ") -> DataFrame:
    """docs(ord, content) -> ord, content: passages of one first line put together in order under the prefix."""
    title = F.substring_index("content", "\n", 1)
    body = F.trim(F.substring("content", F.length(title) + 1, F.length("content")), F.lit("\n"))
    parts = docs.select("ord", "content", title.alias("title"), body.alias("body")).groupBy("title").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "content", "body"))).alias("parts"))
    rest = F.transform(F.slice("parts", 2, F.size("parts")), lambda p: F.concat(F.lit("\n"), p["body"]))
    return parts.select("ord", F.concat(F.lit(prefix), F.col("parts")[0]["content"], F.array_join(rest, "")).alias("content"))


@F.pandas_udf(StringType())
def unicode_decoded(texts: pd.Series) -> pd.Series:
    """\\uXXXX escapes as the characters they name."""
    return texts.map(lambda t: None if t is None else re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), t))
