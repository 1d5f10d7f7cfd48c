"""Word counting shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\t\n\x0b\x0c\r "


def word_count(text: Column) -> Column:
    """Number of WORD matches; null counts 0."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marks, SPACES, "")).cast("long")
