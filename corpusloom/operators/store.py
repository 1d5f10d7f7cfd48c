"""Idempotent stores: anti-join upserts, lookups, read-through memos and cascading deletes.

Null texts have no id and are left out; repeated texts are one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import content_id


def chunked(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts under their content id."""
    docs = docs.where(F.col(text).isNotNull())
    return docs.select(content_id("chunk-", F.col(text)).alias("hash_id"), F.col(text).alias("content")).dropDuplicates(["hash_id"])


def missing(new: DataFrame, store: DataFrame, key: str = "hash_id") -> DataFrame:
    return new.join(store, key, "left_anti")


def upserted(new: DataFrame, store: DataFrame, key: str = "hash_id") -> DataFrame:
    return store.unionByName(missing(new, store, key))


def deleted(store: DataFrame, gone: DataFrame, key: str = "hash_id") -> DataFrame:
    return store.join(gone, key, "left_anti")


def looked_up(asked: DataFrame, store: DataFrame, key: str = "hash_id") -> DataFrame:
    """Rows of the store for asked(ord, key), in ord's numbering; unknown keys have nulls."""
    return asked.join(store, key, "left")


def with_defaults(chunks: DataFrame, found: DataFrame, key: str = "hash_id") -> DataFrame:
    """chunks with found(key, entities, triples): empty lists where a chunk has none."""
    joined = chunks.join(found, key, "left")
    no = {"entities": F.array().cast("array<string>"), "triples": F.array().cast("array<array<string>>")}
    return joined.withColumns({c: F.coalesce(c, d) for c, d in no.items()})


def memo_key(**parts: Column) -> Column:
    """One key for everything that decides an answer: what is left out would share answers that differ."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(parts.items())]), {"ignoreNullFields": "false"}), 256)


def memoised(asked: DataFrame, memo: DataFrame, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """asked(key, ...), memo(key, value), make: (key, ...) -> (key, value).

    Returns asked with value and hit, and the rows to append to the memo: each missing key is made once.
    """
    fresh = make(asked.join(memo, "key", "left_anti").dropDuplicates(["key"]))
    known = memo.select("key", "value", F.lit(True).alias("hit")).unionByName(fresh.select("key", "value", F.lit(False).alias("hit")))
    return asked.join(known, "key", "left"), fresh


def orphans(links: DataFrame, gone: DataFrame, *item: str) -> DataFrame:
    """Items of links(chunk, item...) that only deleted chunks mention: they go with them."""
    return links.join(gone, "chunk", "left_semi").select(*item).distinct().join(links.join(gone, "chunk", "left_anti").select(*item), list(item), "left_anti")
