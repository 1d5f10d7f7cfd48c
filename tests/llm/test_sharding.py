"""The permutation both ways, and the shards of odd tables."""

import zlib

import numpy as np
import pytest

from corpusloom.llm.sharding import Shuffle, numbered, op12_sharding, place, write_shards
from corpusloom.session import Scratch
from tests.llm.helpers import ODD, parquet, table


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 65536, 65537])
def test_permutation(n):
    shuffle, rows = Shuffle(n, 16, key=3), np.arange(n)
    at = shuffle.walk(rows)
    assert sorted(at) == list(range(n)) and (shuffle.walk(at, back=True) == rows).all()
    shard, slot = shuffle.place(rows)
    assert (shuffle.row(shard, slot) == rows).all()
    counts = np.bincount(shard, minlength=16)
    assert counts.max() - counts.min() <= 1
    if n >= 1000:
        assert (at != Shuffle(n, 16, key=4).walk(rows)).mean() > 0.9
        # neighbours do not stay neighbours
        assert np.abs(np.corrcoef(at[:-1], at[1:])[0, 1]) < 0.15


def test_large_numbers():
    shuffle = Shuffle((1 << 40) + 7, 1000)
    rows = np.array([0, 1, (1 << 40) + 6])
    assert (shuffle.row(*shuffle.place(rows)) == rows).all() and (shuffle.walk(rows) < shuffle.n).all()


def checked(got, docs, shards=16):
    want = sorted(str((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()))) for r in docs)
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == want
    slots = {k: sorted(r["slot"] for r in got if r["shard"] == k) for k in range(shards)}
    assert all(s == list(range(len(s))) for s in slots.values()) and {r["shard"] for r in got} <= set(range(shards))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_odd_documents(spark):
    docs = table(spark, ODD + [(8, "copy", "en", "a")] * 40 + [(k % 5, "copy", "en", "a") for k in range(50)] + [(None, None)] * 20)
    placed = place(spark, docs, Scratch(spark)).collect()
    checked(placed, docs.collect())
    # the same for another cut of the files
    again = place(spark, docs.repartition(7), Scratch(spark)).collect()
    key = lambda rows: sorted(str((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"])) for r in rows)
    assert key(placed) == key(again)
    assert key(place(spark, docs, Scratch(spark), key=1).collect()) != key(placed)
    assert place(spark, docs.where("false"), Scratch(spark)).count() == 0
    rows, n = numbered(spark, docs.select("doc_id"), Scratch(spark), "doc_id")
    assert sorted(r["row"] for r in rows.collect()) == list(range(n)) and n == docs.count()


def test_query(spark):
    got = op12_sharding(spark, "/root/testdata/sf0.001").collect()
    checked(got, parquet(spark, "documents").collect())
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_written_shards(spark, tmp_path):
    docs = table(spark, ODD + [(k, f"text {k}", "en", "a") for k in range(100, 160)])
    write_shards(spark, docs, f"file://{tmp_path}/out", Scratch(spark), shards=4, file_rows=5)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    placed = {(r["doc_id"], r["shard"]): r["slot"] for r in place(spark, docs, Scratch(spark), shards=4).collect() if r["doc_id"] and r["doc_id"] >= 100}
    assert placed == {(r["doc_id"], r["_shard"]): r["_slot"] for r in back.select("doc_id", "_shard", "_slot").collect() if r["doc_id"] and r["doc_id"] >= 100}
