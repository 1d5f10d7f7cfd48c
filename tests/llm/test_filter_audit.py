"""The audit's counts against filters that are run one after the other in plain Python."""

import re
from collections import Counter
from itertools import permutations

import pytest

from corpusloom.llm.filter_audit import audited, histograms, masks
from corpusloom.session import Scratch
from tests.llm.helpers import ODD, parquet, table, words

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
LABELS = "doc_id long, quality int, toxic int, part string"


def plain(docs, labels):
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    first = {}
    for r in docs:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            first[t] = min(first.get(t, r["doc_id"]), r["doc_id"])
    kinds = Counter()
    for r in docs:
        t = r["text"] or ""
        w = words(t)
        fails = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * (r["doc_id"] is not None and r["doc_id"] > first[t])
        kinds[(r["source"] or "", fails, r["doc_id"] in good, r["doc_id"] in toxic)] += 1
    out = {}
    for part in {k[0] for k in kinds}:
        own, shapley = {k[1:]: n for k, n in kinds.items() if k[0] == part}, Counter()
        for order in map("".join, permutations("ABCDE")):
            left = dict(own)
            for step, f in enumerate(order, 1):
                gone = {k: n for k, n in left.items() if f in k[0]}
                redundant = sum(n for k, n in own.items() if f in k[0]) - sum(gone.values())
                left = {k: n for k, n in left.items() if f not in k[0]}
                shapley[f] += sum(gone.values())
                out[(part, order, step)] = [sum(left.values()), sum(gone.values()), redundant, sum(n for k, n in own.items() if k[0] == f), sum(n for k, n in gone.items() if k[1]), sum(n for k, n in gone.items() if k[2])]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[(part, order, step)].append(shapley[f])
    return out


def found(spark, docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in audited(histograms(masks(docs, Scratch(spark)), labels)).collect()}


@pytest.mark.parametrize("case", ["odd", "table"])
def test_audit(spark, case):
    if case == "odd":
        long = " ".join(f"w{k}" for k in range(60))
        more = [(20, long, "en", "a"), (21, long, "en", ""), (19, long, "en", None), (19, long, "en", "b"), (22, "ABC " * 80, "en", "a"), (23, long + " #", "en", "a"), (24, long.upper(), "en", "a"), (None, long, "en", "a")]
        docs = table(spark, ODD + more + [(25, long, "en", "a")] * 30)
        labels = spark.createDataFrame([(20, 1, 0, "x"), (20, 0, 1, "x"), (25, 1, 1, "x"), (None, 1, 1, "x"), (22, None, None, "x"), (99, 1, 1, "x")], LABELS)
    else:
        docs, labels = parquet(spark, "documents"), parquet(spark, "labels")
    got, want = found(spark, docs, labels), plain(docs.collect(), labels.collect())
    assert len(got) == len(want) and got == want


def test_nothing(spark):
    docs, labels = table(spark, []), spark.createDataFrame([], LABELS)
    assert found(spark, docs, labels) == {}
    one = found(spark, table(spark, [(1, None, None, None)]), labels)
    assert len(one) == 600 and one[("", "ABCDE", 1)] == [0, 1, 0, 1, 0, 0, 120]
