"""The n-gram join against all pairs, and the pipeline's stages against brute force."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from corpusloom.llm.ngram_join import near_duplicates
from corpusloom.llm.quality_knn import classify, train
from corpusloom.llm.secrets import base_spans
from corpusloom.session import Scratch
from tests.llm.helpers import ODD, parquet, table, words


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_force(rows):
    """(doc_id, set size, component) of every row, from all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 75 * max(len(sets[a]), len(sets[b])) <= 100 * min(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return Counter((i, len(shingles(t)), None if i is None else top(i)) for i, t in rows)


def edited(rng, text, share):
    """A copy with about this share of its words replaced, in one run."""
    w = text.split()
    k = max(1, int(len(w) * share))
    at = rng.randrange(len(w) - k + 1)
    return " ".join(w[:at] + [f"new{rng.randrange(10**6)}" for _ in range(k)] + w[at + k :])


def groups():
    """A chain of edits, a large group of near copies, texts with a common passage, and single texts."""
    rng, rows = random.Random(4), []
    make = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    chain = make(120)
    for _ in range(12):
        rows.append(chain)
        chain = edited(rng, chain, 0.08)
    near = make(200)
    rows += [edited(rng, near, rng.choice((0.01, 0.05, 0.1, 0.2))) for _ in range(150)] + [near] * 20
    passage = make(60)
    rows += [f"{make(80)} {passage} {make(80)}" for _ in range(130)] + [f"{passage} {make(12)}" for _ in range(120)] + [make(rng.randrange(1, 30)) for _ in range(60)]
    rng.shuffle(rows)
    return [(100 + k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("case", ["odd", "groups", "table"])
def test_components_are_those_of_all_pairs(spark, case):
    if case == "table":
        docs = parquet(spark, "documents")
    else:
        docs = table(spark, ODD + [(60, "One  TWO three four"), (61, "one two three four"), (62, "a b c d e"), (63, "a b c d e f")] if case == "odd" else groups())
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = near_duplicates(spark, docs.repartition(3), Scratch(spark)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_force(rows)


def test_ids_that_stand_for_several_texts(spark):
    """Only texts link; a row's component is the least id among the rows that it reaches."""
    one, two, three = ("a b c d e f g h i j k l m n o p", "q r s t u v w x y z a b c", "one two three four five six seven")
    rows = [(5, one), (5, two), (5, two), (7, two), (3, three), (9, three), (9, one), (9, None), (9, ""), (2, "alone it is here now"), (2, "and so is this one too"), (2, "and so is this one too"), (None, one)]
    got = near_duplicates(spark, table(spark, rows), Scratch(spark)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(
        [(5, 12, 5), (5, 9, 5), (5, 9, 5), (7, 9, 5), (3, 3, 3), (9, 3, 3), (9, 12, 5), (9, 0, 9), (9, 0, 9), (2, 1, 2), (2, 2, 2), (2, 2, 2), (None, 12, None)]
    )
    kept = corpus_pipeline.STAGES[1][1](spark, table(spark, rows), "")
    assert kept.columns == table(spark, rows).columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(5, one), (5, two), (3, three), (9, None), (9, ""), (2, "alone it is here now"), (2, "and so is this one too"), (None, one)])


def test_no_documents(spark):
    assert near_duplicates(spark, table(spark, []), Scratch(spark)).count() == 0


@pytest.mark.parametrize("case", ["odd", "table"])
def test_pipeline_stages(spark, case):
    folder, scratch = "/root/testdata/sf0.001", Scratch(spark)
    docs = parquet(spark, "documents") if case == "table" else table(spark, ODD)
    stages, columns, kept = dict(corpus_pipeline.STAGES), docs.columns, {"": docs}
    assert list(stages) == ["quality_classifier", "ngram_jaccard_join", "secret_scan", "mixing", "best_fit_packing"]
    for name, stage in stages.items():
        kept[name] = docs = scratch.save(stage(spark, docs, folder), name)
        assert name == "best_fit_packing" or docs.columns == columns
    rows = {k: [r.asDict() for r in d.collect()] for k, d in kept.items()}
    accepted = classify(spark, kept[""], train(spark, kept[""], parquet(spark, "labels"))).where("predicted = 1").collect()
    assert Counter(r["doc_id"] for r in accepted) == Counter(r["doc_id"] for r in rows["quality_classifier"])
    # one row of each component, that with the smallest id; rows without an id all stay
    components = brute_force([(r["doc_id"], r["text"]) for r in rows["quality_classifier"]])
    want = Counter({c for *_, c in components if c is not None}) + Counter({None: sum(n for (*_, c), n in components.items() if c is None)})
    assert Counter(r["doc_id"] for r in rows["ngram_jaccard_join"]) == want
    assert Counter(r["doc_id"] for r in rows["secret_scan"]) == want
    before = {r["doc_id"]: r["text"] for r in rows["ngram_jaccard_join"]}
    for r in rows["secret_scan"]:
        old = before[r["doc_id"]]
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else r["n_chars"])
        if r["doc_id"] is not None and old:
            assert not any(old[a:b] in r["text"] for a, _, b in base_spans(old))
    # mixed texts hold words of their documents, each document's at most twice; the packing holds every word
    held = {r["doc_id"]: len(words(r["text"])) for r in rows["secret_scan"]}
    mixed = Counter()
    for r in rows["mixing"]:
        mixed[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert all(n <= 2 * held[i] for i, n in mixed.items())
    packed = Counter()
    for r in rows["best_fit_packing"]:
        packed[r["doc_id"]] += r["length"]
    assert packed == +mixed


def test_pipeline_on_empty_documents(spark):
    docs = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark).save(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.count() == 0


def test_queries_are_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{k}" for k in range(1, 11)} <= {n.split("_")[0] for n in names}
