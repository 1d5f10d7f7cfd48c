"""Checks and clean-up of extracted entities and triples as column expressions. Null lists stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip


def clean_entities(entities: Column) -> Column:
    """Stripped, without null and blank ones, the first of equal ones kept in place."""
    trimmed = F.transform(entities, lambda e: strip(e))
    return F.array_distinct(F.filter(trimmed, lambda e: e.isNotNull() & (e != "")))


def valid_triples(triples: Column) -> Column:
    """Triples of exactly three non-blank parts, stripped; the first of equal ones kept in place."""
    trimmed = F.transform(triples, lambda t: F.transform(t, lambda x: strip(x)))
    return F.array_distinct(F.filter(trimmed, lambda t: (F.size(t) == 3) & F.forall(t, lambda x: F.coalesce(x != "", F.lit(False)))))


def reformatted(entities: Column, triples: Column) -> tuple[Column, Column]:
    """Entities sorted and distinct; triples of three parts, the first of equal ones kept in place."""
    return F.array_sort(F.array_distinct(entities)), F.array_distinct(F.filter(triples, lambda t: F.size(t) == 3))


def merged_triples(first: Column, retried: Column) -> Column:
    """The triples of a first and a second extraction, in order, equal ones once."""
    return F.array_distinct(F.concat(F.coalesce(first, F.array()), F.coalesce(retried, F.array())))


def long_enough(entity: Column) -> Column:
    """More than two ASCII letters or digits: only such entities look for synonyms."""
    return F.length(F.regexp_replace(entity, "[^A-Za-z0-9]", "")) > 2


def doubt(failed: Column, finish: Column, n_entities: Column, n_triples: Column) -> Column:
    """Why an extraction should be tried again; '' where it need not."""
    return F.when(failed, "error").when(finish == "length", "length").when(n_triples == 0, "empty_triples").when((n_entities >= 4) & (n_triples < 2), "sparse_triples").otherwise("")
