"""Fixtures: documents with nulls, repeats, ties, long texts and extra columns whose names clash with the operators' own."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard long, rep long, salt int, bits string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(*r, *(None,) * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 7, 7, 7, 7, "x") for i, t, lang, s in full], DOCS)


def words(text):
    return WORDS.findall(text or "")


LONG = " ".join(f"word{k % 977} next{k % 31}" for k in range(30_000))
ODD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "one", "xx", "b"), (5, "one", "xx", "b"), (5, "one", "xx", "b"),
    (None, "no id at all", "en", "b"), (6, LONG, "en", "c"), (7, "é　ß \U0001f600 x y\x00z", "de", "c"), (8, "A\x0bB\x0cC\rD", None, None),
]


def parquet(spark, name, sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")
