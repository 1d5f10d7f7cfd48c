"""Mixing and packing against plain Python, and their invariants."""

from collections import Counter, defaultdict

import pytest

from corpusloom.llm.mixing import mix, mixed_texts, permuted, taken
from corpusloom.llm.packing import CAPACITIES, best_fit, pack
from corpusloom.session import Scratch
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, parquet, table, words


def plain_targets(sizes):
    """Share by weight, cap, and share the excess again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    fixed, wanted = {}, 1.5 * sum(sizes.values())
    while True:
        rest, free = wanted - sum(fixed.values()), [s for s in names if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("case", ["odd", "table"])
def test_mix(spark, case):
    docs = table(spark, ODD) if case == "odd" else parquet(spark, "documents")
    rows = docs.collect()
    m = mix(spark, docs, Scratch(spark))
    got = taken(m).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(str((r["doc_id"], r["size"])) for r in got) == sorted(str((r["doc_id"], len(words(r["text"])))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    want = plain_targets(sizes)
    targets = sorted({round(r["target"], 6) for r in got})
    assert targets == pytest.approx(sorted({round(t, 6) for t in want.values()}))
    total = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        total[round(r["target"], 6)] += r["taken"]
    for t, n in total.items():
        assert abs(n - t * sum(abs(x - t) < 1e-5 for x in want.values())) <= len(want)
    again = taken(mix(spark, docs.repartition(5), Scratch(spark))).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    texts = mixed_texts(spark, docs, m)
    assert texts.columns == docs.columns
    # the words taken stand in the texts that come out
    assert sum(len(words(r["text"])) for r in texts.collect()) == sum(r["taken"] for r in got)


def test_repeated_rows_and_their_texts(spark):
    """Copies count one by one; each source takes its target of them, and the texts hold what is taken."""
    text = " ".join(f"w{k}" for k in range(700))
    docs = table(spark, [(1, text, "en", "a")] * 150 + [(1, text, "en", "b")] * 40 + [(1, text + " more", "en", "a"), (None, text, "en", "a"), (None, text, "en", "a")])
    m = mix(spark, docs, Scratch(spark), bucket_rows=1)
    got = taken(m).collect()
    assert Counter(r["size"] for r in got) == {700: 192, 701: 1}
    texts = mixed_texts(spark, docs, m).collect()
    assert sum(len(words(r["text"])) for r in texts) == sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), abs=1)
    by = Counter()
    for r in texts:
        by[r["source"]] += len(words(r["text"]))
    assert by == {r["source_size"] == 40 * 700 and "b" or "a": round(r["target"]) for r in got}


def test_repeated_rows_without_words_stay_apart(spark):
    docs = table(spark, [*ODD, (2, "", None, "a"), (9, None, "en", "a"), (9, None, "en", "a"), (None, "  ", "en", "b"), (None, "  ", "en", "b")])
    got = taken(mix(spark, docs, Scratch(spark))).select("doc_id", "size").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((r["doc_id"], len(words(r["text"])))) for r in docs.collect())


def test_permutation_and_its_inverse(spark):
    for n in (1, 2, 7, 1000):
        f = spark.range(n).withColumn("y", permuted(F.col("id"), F.lit(n), F.lit(5))).withColumn("z", permuted(F.col("y"), F.lit(n), F.lit(5), back=True))
        rows = f.collect()
        assert sorted(r["y"] for r in rows) == list(range(n)) and all(r["z"] == r["id"] for r in rows)


def cheapest_length(first, rest, capacities, bin_cost):
    """The length whose bin, filled greedily with the longest piece that fits, again and again, costs least per word."""
    costs = []
    for capacity in (c for c in sorted(capacities) if c >= first):
        held, left = first, sorted(rest, reverse=True)
        for x in left:
            if held + x <= capacity and x <= first:
                held += x
        costs.append(((min(c for c in capacities if c >= held) + bin_cost) / held, capacity))
    return min(costs)[1]


def slow_best_fit(lengths, capacities):
    """The same choices by looking at every open bin."""
    bins, where = [], []
    for i, x in enumerate(lengths):
        fits = [b for b in bins if b["room"] >= x]
        if fits:
            best = min(b["room"] for b in fits)
            chosen = [b for b in fits if b["room"] == best]
            where.append({id(b) for b in chosen})
            b = max(chosen, key=lambda b: b["at"])
        else:
            b = {"room": cheapest_length(x, lengths[i + 1 :], capacities, 32), "no": len(bins), "in": 0}
            bins.append(b)
            where.append({id(b)})
        b["room"], b["in"], b["at"] = b["room"] - x, b["in"] + x, i
    return [b["in"] for b in bins]


def test_best_fit_against_looking_at_every_bin():
    lengths = sorted([(k * k * 37) % 900 + 1 for k in range(300)], reverse=True)
    bins, offsets, final = best_fit(lengths)
    assert slow_best_fit(lengths, CAPACITIES) == [sum(x for x, b in zip(lengths, bins) if b == k) for k in range(len(final))]


@pytest.mark.parametrize("case", ["odd", "table"])
def test_pack(spark, case):
    docs = table(spark, ODD) if case == "odd" else parquet(spark, "documents")
    got = pack(spark, docs, Scratch(spark)).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["text_id"], r["copy"]].append((r["begin"], r["length"]))
        bins[r["bin_id"]].append((r["bin_offset"], r["length"], r["capacity"]))
    whole = Counter()
    for (doc, _, _), parts in pieces.items():
        at = 0
        for begin, length in sorted(parts):
            assert begin == at and 0 < length <= max(CAPACITIES)
            at += length
        whole[doc, at] += 1
    assert whole == Counter((r["doc_id"], len(words(r["text"]))) for r in docs.collect() if words(r["text"]))
    for parts in bins.values():
        at = 0
        for offset, length, capacity in sorted(parts):
            assert offset == at
            at += length
        assert {c for *_, c in parts} == {min(c for c in CAPACITIES if c >= at)}
    if case == "table":
        used, held = sum(r["length"] for r in got), sum(p[0][2] for p in bins.values())
        assert used >= 0.9 * held


def test_empty_tables(spark):
    empty = table(spark, [])
    assert pack(spark, empty, Scratch(spark)).count() == 0
    m = mix(spark, empty, Scratch(spark))
    assert taken(m).count() == 0 and mixed_texts(spark, empty, m).count() == 0


def test_mixed_texts_are_planned_in_parts(spark):
    """The mix is written before texts are cut by it: its windows are no part of their plan, which the driver holds."""
    docs = spark.createDataFrame([(k, "one two three " * (k + 1), "ab"[k % 2]) for k in range(6)], "doc_id long, text string, source string")
    out = mixed_texts(spark, docs, mix(spark, docs, Scratch(spark), block_words=4), 4)
    assert "Window" not in out._jdf.queryExecution().sparkPlan().toString() and not out.isEmpty()
