"""Quality rules by distribution divergence.

A document's character-class and common-word histograms are compared with a reference of its language
by Jensen-Shannon distance. References are fitted on the rows of a table that pass the base rule, each with
one vote whatever its length; they can be fitted apart from what is judged, stored with a version, and
given to later runs, so that the verdict on a text does not depend on the table it stands in. Languages
without a list of common words are judged by characters alone, and their references lean on a shared one
of all such languages, by 1 / (1 + (rows / PRIOR)^2): with many rows of its own a language has its own
reference, with few it has nearly the shared one, and no number of rows switches from one to the other.

Defined results: a null or empty text has all counts 0 and fails the base rule; null ids and repeated
rows give one row each; a null or empty language counts as one language; one that the references lack uses
the shared reference; without any row that passes the base rule all distances are 0; an empty table gives an empty
result; columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.textbytes import FOLD, SPACE, Texts, batches, keyed
from corpusloom.session import Scratch

# Frequent function words of four languages.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son aux elle mais comme cette nous leur être tout ont été fait lui même ces si sans",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde",
}
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "newline", "punctuation", "symbol", "other")
#: Class of each byte; bytes inside a multi-byte character count for nothing (class 8).
CLASS = np.full(256, 5, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 1, 2
CLASS[SPACE] = 3
CLASS[10] = 4
CLASS[list(SYMBOLS)] = 6
CLASS[192:] = 7
CLASS[128:192] = 8
LISTS = {k: list(dict.fromkeys(v.split())) for k, v in COMMON.items()}
WIDTH = max(map(len, LISTS.values())) + 1
#: Key of the shared reference, and the rows of a language without a list at which that is half of its reference.
SHARED, PRIOR = "*", 5.0
#: Languages without a list that may have references of their own, most rows first; they are kept on the driver.
LANGUAGES = 5_000
#: Steps of a share when medians are taken, and of a vote when votes are summed (whole numbers add up the same in any order).
STEPS, VOTE = 4096, 1 << 30

SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, words array<long>"
REFERENCES = "version string, lang string, n_rows long, chars array<double>, words array<double>"


def word_keys() -> dict[str, np.ndarray]:
    out = {}
    for lang, words in LISTS.items():
        t = Texts([" ".join(words)])
        out[lang] = t.span_hash(t.starts, t.ends, FOLD)
    return out


def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Base counts and both histograms of each text."""
    keys, plain = word_keys(), np.arange(256, dtype=np.uint8)
    for own, t in batches(frames):
        folded = t.span_hash(t.starts, t.ends)
        exact = t.span_hash(t.starts, t.ends, plain)
        classes = CLASS[t.data].copy()
        classes[t.bounds[1:] - 1] = 8  # the separators belong to no text
        chars = np.stack([t.total(classes == k) for k in range(8)], axis=1)
        runs, at = t.windows(exact, 3)
        _, place, counts = np.unique(keyed(t.doc[at], runs), return_inverse=True, return_counts=True)
        again = at[counts[place] > 1]
        marks = np.zeros(len(t.starts), bool)
        for k in range(3):
            marks[again + k] = True
        ends = np.flatnonzero(t.data == 10)
        begins = np.concatenate([[0], ends[:-1] + 1])
        full = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, begins)
        begins, ends = begins[full], ends[full]
        line_doc = np.searchsorted(t.bounds, begins, side="right") - 1
        _, first = np.unique(keyed(line_doc, t.span_hash(begins, ends, plain)), return_index=True)
        n_lines, n_first = np.bincount(line_doc, minlength=t.n), np.bincount(line_doc[first], minlength=t.n)
        lang = own["lang"].where(own["lang"].notna(), "")
        words = np.zeros((t.n, WIDTH), np.int64)
        for name, known in keys.items():
            of = (lang == name).to_numpy()
            if of.any():
                order = np.argsort(known)
                mine = np.flatnonzero(of[t.doc])
                slot = np.minimum(np.searchsorted(known[order], folded[mine]), len(known) - 1)
                hit = known[order][slot] == folded[mine]
                np.add.at(words, (t.doc[mine][hit], order[slot[hit]]), 1)
        words[:, -1] = t.n_words - words.sum(axis=1)
        yield pd.DataFrame({
            "doc_id": own["doc_id"], "lang": lang, "n_words": t.n_words, "word_chars": t.total(~t.space & ((t.data & 0xC0) != 0x80)), "n_symbols": chars[:, 6],
            "n_dup_lines": n_lines - n_first, "n_repeat_words": np.bincount(t.doc[marks], minlength=t.n), "chars": list(chars), "words": list(words),
        })


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) between rows of counts p and one histogram q; rows without counts are at 0."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = np.broadcast_to(q / max(q.sum(), 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=1)
        out = np.sqrt(np.maximum(0, (part(p) + part(q)) / 2))
    return np.where(p.sum(axis=1) > 0, out, 0.0)


def shares(column: pd.Series) -> np.ndarray:
    """Histograms, one a row, each divided by its sum."""
    counts = np.stack(column).astype(float)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def refer(lang: pd.Series, own: set[str]) -> pd.Series:
    """Key of each row's reference."""
    return lang.where(lang.isin(list(own)), SHARED)


def leaning(n: int, prior: float) -> float:
    """Part of the shared reference in that of a language with n rows."""
    return 1 / (1 + (n / prior) ** 2) if prior else 0.0


def pooled(f: pd.DataFrame, own: set[str]) -> pd.DataFrame:
    """Rows with the references they count for (ref): their language's, and the shared one if that has no list."""
    f = f.assign(ref=refer(f["lang"], own))
    return pd.concat([f, f[~f["ref"].isin([*LISTS, SHARED])].assign(ref=SHARED)], ignore_index=True)


def tallied(frames: Iterator[pd.DataFrame], own: set[str]) -> Iterator[pd.DataFrame]:
    """How often each share occurs, for the character classes (slots 0 to 7) and the words that are on no list (8)."""
    for f in frames:
        if len(f):
            f = pooled(f, own)
            share = np.column_stack([shares(f["chars"]), shares(f["words"])[:, -1]])
            cells = pd.DataFrame({"ref": np.repeat(f["ref"].to_numpy(), 9), "slot": np.tile(np.arange(9), len(f)), "step": np.rint(share * STEPS).astype(int).ravel()})
            yield cells.groupby(["ref", "slot", "step"]).size().rename("n").reset_index()


def medians(rows: DataFrame, own: set[str], counts: dict[str, int], prior: float) -> dict[str, tuple[np.ndarray, float]]:
    """By reference: median share of each character class, and of words that are on no list; the shared ones mixed in."""
    cells = rows.mapInPandas(lambda frames: tallied(frames, own), "ref string, slot int, step int, n long").groupBy("ref", "slot", "step").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("ref", "slot")
    upto = cells.withColumn("upto", F.sum("n").over(of.orderBy("step"))).withColumn("all", F.sum("n").over(of))
    out = {}
    for r in upto.where("2 * upto >= all").groupBy("ref", "slot").agg(F.min("step").alias("step")).collect():
        out.setdefault(r["ref"], np.zeros(9))[r["slot"]] = r["step"] / STEPS
    for ref in out.keys() - {*LISTS, SHARED}:
        part = leaning(counts[ref], prior)
        out[ref] = (1 - part) * out[ref] + part * out[SHARED]
    return {ref: (m[:8], m[8]) for ref, m in out.items()}


def votes(frames: Iterator[pd.DataFrame], own: set[str], centres: dict, trim: float) -> Iterator[pd.DataFrame]:
    """Summed votes of the rows near their medians and of the others."""
    for f in frames:
        for name, mine in pooled(f, own).groupby("ref"):
            chars, words = shares(mine["chars"]), shares(mine["words"])
            near = js_distance(chars, centres[name][0]) <= trim
            if name in LISTS:
                rest = np.column_stack([1 - words[:, -1], words[:, -1]])
                near &= js_distance(rest, np.array([1 - centres[name][1], centres[name][1]])) <= trim + 1 / np.sqrt(mine["n_words"].to_numpy().clip(1))
            for side in (True, False):
                if (near == side).any():
                    added = [np.rint(x[near == side] * VOTE).astype(np.int64).sum(axis=0) for x in (chars, words)]
                    yield pd.DataFrame({"ref": [name], "near": [side], "chars": [added[0]], "words": [added[1]]})


def fitted(rows: DataFrame, trim: float, prior: float) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Of measured rows that pass the base rule: by language, the number of rows and both histograms of the reference.

    The first reference has the median share of each class, which junk does not move while it is in less than half
    of the rows. The final one has the mean shares of the rows within trim of the first; where there are none,
    the first one stays, with the mean word shares of all rows. Both of a language without a list lean on the shared one.
    """
    ranked = rows.where(F.col("lang") != SHARED).groupBy("lang").count().orderBy(~F.col("lang").isin(list(LISTS)), F.desc("count"), "lang")
    counts = {r["lang"]: r["count"] for r in ranked.limit(len(LISTS) + LANGUAGES).collect()}
    own = set(counts)
    centres = medians(rows, own, counts, prior)
    add = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c)
    cells = rows.mapInPandas(lambda frames: votes(frames, own, centres, trim), "ref string, near boolean, chars array<long>, words array<long>")
    refs = {}
    for r in cells.groupBy("ref", "near").agg(add("chars", 8), add("words", WIDTH)).orderBy("near").collect():
        chars = np.array(r["chars"], float)
        chars = chars if r["near"] or not centres[r["ref"]][0].any() else centres[r["ref"]][0]
        refs[r["ref"]] = (chars / max(chars.sum(), 1e-9), np.array(r["words"], float))
    for ref in refs.keys() - {*LISTS, SHARED}:
        part = leaning(counts[ref], prior)
        refs[ref] = ((1 - part) * refs[ref][0] + part * refs[SHARED][0], refs[ref][1])
    return {ref: (counts.get(ref, 0), *both) for ref, both in refs.items()}


def passing(min_words: int, max_repeat_percent: int) -> Column:
    return (F.col("n_words") >= min_words) & (100 * F.col("n_repeat_words") <= max_repeat_percent * F.col("n_words"))


def counted(docs: DataFrame, scratch: Scratch) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    return scratch.save(rows.mapInPandas(measured, SCHEMA), "measured")


def fit_references(spark: SparkSession, docs: DataFrame, scratch: Scratch, version: str, min_words: int = 50, max_repeat_percent: int = 50, trim: float = 0.2, prior: float = PRIOR) -> DataFrame:
    """docs(doc_id, text, lang) -> REFERENCES, one row a language; for quality_rules here or in a later run."""
    refs = fitted(counted(docs, scratch).where(passing(min_words, max_repeat_percent)), trim, prior)
    return spark.createDataFrame([(version, ref, n, *[[float(x) for x in h / max(h.sum(), 1)] for h in both]) for ref, (n, *both) in sorted(refs.items())], REFERENCES)


def given(references: DataFrame) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """References of one version, by language; histograms of another form are refused."""
    rows = references.select("version", "lang", "n_rows", "chars", "words").limit(len(LISTS) + LANGUAGES + 2).collect()
    if len({r["version"] for r in rows}) > 1 or len({r["lang"] for r in rows}) < len(rows) or len(rows) > len(LISTS) + LANGUAGES + 1:
        raise ValueError("references must be of one version, with one row a language")
    if any(len(r["chars"]) != len(CLASSES) or len(r["words"]) != WIDTH for r in rows):
        raise ValueError(f"references must have {len(CLASSES)} character classes and {WIDTH} word slots")
    return {r["lang"]: (r["n_rows"], np.array(r["chars"]), np.array(r["words"])) for r in rows}


def distances(f: pd.DataFrame, refs: dict) -> tuple[np.ndarray, np.ndarray]:
    """Character and word distance of each row to its reference."""
    chars, words = np.zeros(len(f)), np.zeros(len(f))
    ref = refer(f["lang"], set(refs))
    for name in ref.unique():
        of = np.flatnonzero(ref == name)
        if name in refs:
            chars[of] = js_distance(np.stack(f["chars"].iloc[of]).astype(float), refs[name][1])
            if name in LISTS:
                words[of] = js_distance(np.stack(f["words"].iloc[of]).astype(float), refs[name][2])
    return chars, words


def quality_rules(
    spark: SparkSession,
    docs: DataFrame,
    scratch: Scratch,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    trim: float = 0.2,
    char_limit: float = 0.1,
    char_slack: float = 0.6,
    word_limit: float = 0.15,
    word_slack: float = 1.0,
    prior: float = PRIOR,
    references: DataFrame | None = None,
) -> DataFrame:
    """docs(doc_id, text, lang) -> base counts, base_failed, both distances and kept.

    references are fit_references' of another table; without them they are fitted on docs.

    Texts under min_words are not judged by divergence. A text is rejected when its two distances, each
    divided by limit + slack / sqrt(n_words), add up to more than 2; the slack is there because short
    texts are far from any reference by chance alone.
    """
    rows = counted(docs, scratch)
    refs = fitted(rows.where(passing(min_words, max_repeat_percent)), trim, prior) if references is None else given(references)

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["char_distance"], f["word_distance"] = distances(f, refs)
            f["base_failed"] = (f["n_words"] < min_words) | (100 * f["n_repeat_words"] > max_repeat_percent * f["n_words"])
            short = 1 / np.sqrt(f["n_words"].clip(lower=1))
            far = f["char_distance"] / (char_limit + char_slack * short) + f["word_distance"] / (word_limit + word_slack * short) > 2
            f["kept"] = ~f["base_failed"] & ~(far & (f["n_words"] >= min_words))
            yield f.drop(columns=["lang", "chars", "words"])

    return rows.mapInPandas(judged, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double, base_failed boolean, kept boolean")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
