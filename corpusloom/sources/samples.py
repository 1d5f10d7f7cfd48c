"""Gold documents and answers of question sets, in the layouts they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has(samples: DataFrame, *names: str) -> bool:
    return all(n in samples.columns for n in names)


def gold_documents(samples: DataFrame, sentence_gap: str = " ") -> Column:
    """Array of the distinct supporting documents of each sample, by the first layout that its columns fit.

    supporting_facts(title, ...) with context(title, sentences), sentences joined by sentence_gap; contexts
    (title, text, is_supporting); paragraphs(title, text or paragraph_text), where a missing flag counts as true.
    """
    line = F.lit("\n")
    if has(samples, "supporting_facts", "context"):
        titles = F.transform("supporting_facts", lambda f: f["title"])
        own = F.filter("context", lambda c: F.array_contains(titles, c["title"]))
        return F.array_distinct(F.transform(own, lambda c: F.concat(c["title"], line, F.array_join(c["sentences"], sentence_gap))))
    name = "contexts" if has(samples, "contexts") else "paragraphs"
    fields = samples.schema[name].dataType.elementType.fieldNames()
    texts = [f for f in ("text", "paragraph_text") if f in fields]
    flagged = (lambda p: F.coalesce(p["is_supporting"], F.lit(name == "paragraphs"))) if "is_supporting" in fields else (lambda p: F.lit(True))
    own = F.filter(name, flagged)
    return F.array_distinct(F.transform(own, lambda p: F.concat(p["title"], line, F.coalesce(*[p[t] for t in texts]))))


def gold_answers(samples: DataFrame) -> Column:
    """Array of the distinct answers of each sample: answer, else gold_ans, else reference, else obj with its other names; and answer_aliases."""

    def listed(name: str) -> Column:
        kind = samples.schema[name].dataType.typeName()
        return F.col(name) if kind == "array" else F.when(F.col(name).isNotNull(), F.array(F.col(name).cast("string")))

    found = [listed(n) for n in ("answer", "gold_ans", "reference") if has(samples, n)]
    if has(samples, "obj"):
        names = [listed(n) for n in ("obj", "possible_answers", "o_wiki_title", "o_aliases") if has(samples, n)]
        found.append(F.when(F.col("obj").isNotNull(), F.flatten(F.filter(F.array(*names), lambda x: x.isNotNull()))))
    none = F.array().cast("array<string>")
    more = F.coalesce(listed("answer_aliases"), none) if has(samples, "answer_aliases") else none
    return F.array_distinct(F.concat(F.coalesce(*found), more))
