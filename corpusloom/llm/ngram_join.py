"""N-gram Jaccard join: exact links between shingle sets, and their components.

Equal sets become one class. Sets are compared within tiles: a tile holds sets of neighbouring size
bands that share a prefix shingle (any two sets as alike as asked share one, in every total order of
shingles; ours puts shingles last that are frequent anywhere). Hashed bitmaps bound each pair's overlap
from above; pairs that pass are decided by intersecting the sorted shingle arrays.

Work goes in two steps, so that a group of thousands of near copies is never expanded into its pairs:
first each tile row is compared with one pivot only; then tiles whose members still belong to several
components are compared in full, skipping pairs that are already joined.

Defined results: null and blank texts have no shingle and are linked with nothing; texts under the
shingle's width have one shingle, their words; null ids come back with a null component and take no
part; repeated rows give one row each; an id with several texts has a node for each of its sets, and only
the texts decide what is linked; an empty table gives an empty result; columns that are not named are
ignored. Shingles stand for their 64-bit hashes, sets for the 128-bit hashes of these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.streams import whole_groups
from corpusloom.llm.textbytes import BASE, Texts, batches, keyed, power_table
from corpusloom.session import Scratch, partitions, salted_join, small

#: Shingles met in this many texts of a stretch of STRETCH shingles are reported as frequent; about HOT of them, the most frequent, are kept.
LOCAL_MANY = 3
STRETCH = 1 << 22
HOT = 1 << 20
#: Members of a tile row; a full comparison holds two of them.
TILE = 512
MAX_BITS = 8192
#: A set's prefix is longer by one shingle for each so many; linked sets then share as many more.
SHARED_EACH = 32
#: Groups of this size are met with further pivots before they are compared in full.
LARGE, TURNS = 100, 2


def shingle_sets(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted by text and hash, and the first index of each text (and the end)."""
    words = t.span_hash(t.starts, t.ends)
    found, at = t.windows(words, width)
    doc = t.doc[at]
    short = np.flatnonzero((t.n_words > 0) & (t.n_words < width))
    for k in short:
        own = words[t.doc == k]
        value = (own * power_table(BASE, len(own) + 1)[1:]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own))
        found, doc = np.append(found, value), np.append(doc, k)
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[new], doc[new]
    return found, np.searchsorted(doc, np.arange(t.n + 1))


class Stretch:
    """Shingles of a stretch of texts in one buffer, which is sorted in place."""

    def __init__(self):
        self.held, self.used = np.empty(STRETCH, np.uint64), 0

    def add(self, sets: np.ndarray) -> Iterator[pd.DataFrame]:
        while len(sets):
            room = min(STRETCH - self.used, len(sets))
            self.held[self.used : self.used + room] = sets[:room]
            self.used, sets = self.used + room, sets[room:]
            if self.used == STRETCH:
                yield self.frequent()

    def frequent(self) -> pd.DataFrame:
        """Shingles that LOCAL_MANY of the texts share, with their numbers."""
        own, self.used = self.held[: self.used], 0
        own.sort()
        again = own[LOCAL_MANY - 1 :][own[LOCAL_MANY - 1 :] == own[: max(0, len(own) - LOCAL_MANY + 1)]]
        hashes, counts = np.unique(again, return_counts=True)
        none = pd.array([None] * len(hashes), "Int64")
        return pd.DataFrame({"kind": np.ones(len(hashes), np.int32), "doc_id": none, "text_id": none, "n": counts + LOCAL_MANY - 1, "print": None, "shingle": hashes.view(np.int64)})


def least_shared(n):
    """Shingles that the prefixes of a set of n and of any set linked with it share at least: prefixes are longer by one less than this."""
    return 1 + n // SHARED_EACH


def band(n: Column, percent: int) -> Column:
    """Size band: sets that may link lie in the same or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")


def bitmap(hashes: np.ndarray) -> bytes:
    """Bits of a set, at least four per shingle, up to MAX_BITS; a power of two, so that longer maps fold onto shorter ones."""
    bits = 64
    while bits < min(4 * len(hashes), MAX_BITS):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(hashes % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(raw: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to the shortest one's length."""
    least = min(map(len, raw))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(r, np.uint64).reshape(-1, least // 8), axis=0) for r in raw])


def least_overlap(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection with 100 * intersection >= percent * union."""
    return -(-percent * (na + nb) // (100 + percent))


def links(spark: SparkSession, docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> rows (doc_id, text_id, n_shingles, rep) and components (id, component) of the reps.

    A rep is the node of a set: the least id of its rows, or a number beyond all ids where each of its
    rows has an id that stands for other texts too. Rows without an id or a shingle have none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_id"))

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch = Stretch()
        for own, t in batches(frames):
            sets, at = shingle_sets(t, width)
            prints = [hashlib.md5(sets[a:b].tobytes()).digest() if b > a else None for a, b in zip(at, at[1:])]
            yield pd.DataFrame({"kind": 0, "doc_id": own["doc_id"].astype("Int64"), "text_id": own["text_id"].astype("Int64"), "n": np.diff(at), "print": prints, "shingle": 0})
            yield from stretch.add(sets)
        yield stretch.frequent()

    found = scratch.save(docs.mapInPandas(measured, "kind int, doc_id long, text_id long, n long, print binary, shingle long"), "measured")
    hot = scratch.save(found.where("kind = 1").groupBy("shingle").agg(F.sum("n").alias("n")), "hot")
    many = hot.count()
    if many > HOT:
        hot = hot.where(F.col("n") > hot.agg(F.percentile_approx("n", 1 - HOT / many, 10_000)).first()[0])
    hot = hot.select("shingle").toPandas()
    hot_list = spark.sparkContext.broadcast(np.sort(hot["shingle"].to_numpy(np.int64).view(np.uint64)))

    found = found.where("kind = 0").drop("kind", "shingle")
    several = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).where("lo != hi").select("doc_id")
    several = scratch.save(several, "several")
    n_several = several.count()
    found = found.join(small(several, n_several).withColumn("sure", F.lit(False)), "doc_id", "left") if n_several else found.withColumn("sure", F.lit(True))
    sure = F.coalesce("sure", F.lit(True))
    classes = found.where("print is not null and doc_id is not null").groupBy("print").agg(F.min(F.when(sure, F.col("doc_id"))).alias("rep"), F.count("*").alias("copies"), F.min(F.when(~sure, F.struct("doc_id", "text_id"))).alias("odd"))
    classes = classes.where("copies > 1 or odd is not null")
    if n_several:
        low, high = found.agg(F.min("doc_id"), F.max("doc_id")).first()
        number = F.monotonically_increasing_id()
        beyond = number + F.lit(high + 1) if high < 1 << 62 else F.lit(low - 1) - number
        classes = classes.withColumn("fresh", F.col("rep").isNull()).withColumn("rep", F.coalesce("rep", beyond))
    classes = scratch.save(classes, "classes")
    if n_several:
        odd = classes.where("fresh").select("odd.doc_id", "odd.text_id", "rep")
        odd = docs.join(small(odd, n_several), ["doc_id", "text_id"]).select(F.col("rep").alias("doc_id"), "text")
        docs = docs.join(small(several, n_several), "doc_id", "left_anti").select("doc_id", "text").unionByName(odd)
    copies = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    # one print may belong to a third of all rows: its class row is repeated, and the rows are dealt over the repeats
    salts = F.greatest(F.lit(1), F.least(F.lit(256), F.floor(F.col("copies") / 1000))).cast("int")
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    wide = classes.select("print", salts.alias("salts")).distinct()
    rows = found.join(small(wide, copies[0]), "print", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    rows = rows.join(small(classes.select("print", "salt", "rep"), copies[0]), ["print", "salt"], "left")
    rep = F.when(F.col("print").isNotNull() & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    rows = scratch.save(rows.select("doc_id", "text_id", F.col("n").alias("n_shingles"), rep.alias("rep")), "rows")

    # texts that only repeat another set need no postings
    repeats = rows.where("rep != doc_id").select("doc_id")
    lone = docs.where("doc_id is not null").join(small(repeats, copies[1]), "doc_id", "left_anti")

    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late = hot_list.value
        for own, t in batches(frames):
            sets, at = shingle_sets(t, width)
            n = np.diff(at)
            doc = np.repeat(np.arange(t.n), n)
            slot = np.minimum(np.searchsorted(late, sets), max(0, len(late) - 1))
            often = late[slot] == sets if len(late) else np.zeros(len(sets), bool)
            order = np.lexsort((sets, often, doc))
            place = np.arange(len(sets)) - at[doc]
            keep = place < (n - -(-percent * n // 100) + least_shared(n))[doc]
            sets, doc, often = sets[order][keep], doc[keep], often[order][keep]
            ids = own["doc_id"].to_numpy(np.int64)[doc]
            # salts begin at 1: a salted row always waits for the sharers in other salts
            salt = np.where(often, keyed(doc, ids.view(np.uint64)) % np.uint64(64) + np.uint64(1), 0)
            yield pd.DataFrame({"shingle": sets.view(np.int64), "salt": salt.astype(np.int16), "rep": ids, "n": n[doc]})

    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    posts = lone.mapInPandas(prefixes, "shingle long, salt short, rep long, n long")
    posts = posts.repartition(partitions(spark, total // 4), "shingle", "salt").sortWithinPartitions("shingle", "salt", "n", "rep")
    shared = scratch.save(posts.mapInPandas(lambda frames: runs(frames, percent), RUNS).drop("pivot"), "shared")
    # linked sets share least_shared shingles of their prefixes; sets with fewer can't be linked with any
    able = shared.groupBy("rep").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(F.col("c") >= 1 + F.floor(F.ceil(percent * F.col("n") / 100) / SHARED_EACH)).select("rep")
    able = scratch.save(able, "able")
    again = shared.join(small(able, able.count()), "rep", "left_semi").select("shingle", "salt", "rep", "n")
    again = again.repartition(partitions(spark), "shingle", "salt").sortWithinPartitions("shingle", "salt", "n", "rep")
    rows_of = scratch.save(again.mapInPandas(lambda frames: runs(frames, percent), RUNS), "posts")
    scratch.drop("shared")
    salted = rows_of.where("salt >= 0 and pivot = rep").select("shingle", "rep", "n", F.lit(0).cast("short").alias("salt"))
    pivots = salted.repartition(partitions(spark), "shingle").sortWithinPartitions("shingle", "salt", "n", "rep")
    pivots = pivots.select("shingle", "salt", "rep", "n").mapInPandas(lambda frames: runs(frames, percent), RUNS)
    stars = rows_of.unionByName(pivots).where("pivot != rep").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
    stars = scratch.save(stars, "stars")

    scratch.drop("measured", "hot")
    if not n_several:
        scratch.drop("classes", "several")
    bits = described(spark, docs, stars, scratch, width, "bits")
    passed = scratch.save(bounded_pairs(stars, bits, percent), "passed-1")
    first = scratch.save(exact_links(passed, described(spark, docs, passed, scratch, width, "shingles"), percent), "links-1")
    joined = components(spark, first, scratch, "first")
    for turn in range(1, TURNS + 1):
        more = scratch.save(further_stars(rows_of, joined, scratch, turn, percent), f"stars-{turn}")
        if more.isEmpty():
            break
        passed = scratch.save(bounded_pairs(more, bits, percent), f"passed-turn-{turn}")
        found_links = scratch.save(exact_links(passed, described(spark, docs, passed, scratch, width, "shingles"), percent), f"links-turn-{turn}")
        if found_links.isEmpty():
            break
        first = first.unionByName(found_links)
        joined = components(spark, first, scratch, f"turn-{turn}")
    wide = scratch.save(in_large(rows_of, joined), "wide")
    if not wide.isEmpty():
        sets = described(spark, docs, wide.select(F.col("rep").alias("a"), F.col("rep").alias("b")), scratch, width, "shingles").drop("n")
        dealt = meetings(wide, bits.select("rep", "bits").join(sets, "rep"), partitions(spark), percent)
        first = first.unionByName(scratch.save(dealt.mapInPandas(lambda frames: met(frames, percent, True), "a long, b long, least long").select("a", "b").distinct(), "links-large"))
        joined = components(spark, first, scratch, "large")
    left = scratch.save(open_pairs(spark, rows_of, joined, bits, scratch, percent), "passed-2")
    scratch.drop("posts", "stars", "bits", "shingles", "open", "wide", "passed-1")
    if not left.isEmpty():
        second = scratch.save(exact_links(left, described(spark, docs, left, scratch, width, "shingles"), percent), "links-2")
        joined = components(spark, first.unionByName(second), scratch, "second")
        scratch.drop("shingles", "passed-2")
    return rows, joined


RUNS = "shingle long, salt short, rep long, n long, pivot long"


def with_components(rows: DataFrame, joined: DataFrame, least: int, most: int = 1 << 62) -> tuple[DataFrame, DataFrame]:
    """Rows (shingle, rep, n, component), and the shingles of least to most rows and of several components."""
    rows = rows.select("shingle", "rep", "n").join(joined.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
    return rows, mixed.where(f"lo != hi and members between {least} and {most}").select("shingle")


def further_stars(rows: DataFrame, joined: DataFrame, scratch: Scratch, turn: int, percent: int) -> DataFrame:
    """Pairs of one more pivot per large group, another one each turn, with members of other components."""
    rows, mixed = with_components(rows, joined, LARGE)
    rows = scratch.save(rows.join(mixed, "shingle", "left_semi"), f"large-{turn}")
    pivots = rows.groupBy("shingle").agg(F.min_by(F.struct("rep", "n", "component"), F.xxhash64("rep", F.lit(turn))).alias("p"))
    pivots = scratch.save(pivots.select("shingle", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.component").alias("pc")), f"pivots-{turn}")
    met = rows.join(small(pivots, pivots.count()), "shingle").where(f"component != pc and 100 * least(n, pn) >= {percent} * greatest(n, pn)")
    return met.select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()


def described(spark: SparkSession, docs: DataFrame, pairs: DataFrame, scratch: Scratch, width: int, what: str) -> DataFrame:
    """(rep, n, bits or shingles) of the sets in pairs, made from their texts."""
    wanted = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    n_wanted = wanted.count()

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, t in batches(frames):
            sets, at = shingle_sets(t, width)
            own_sets = [sets[a:b] for a, b in zip(at, at[1:])]
            yield pd.DataFrame({"rep": own["doc_id"], "n": np.diff(at), what: [bitmap(x) if what == "bits" else x.tobytes() for x in own_sets]})

    found = docs.join(small(wanted, n_wanted), "doc_id", "left_semi").mapInPandas(made, f"rep long, n long, {what} binary")
    return scratch.save(found.dropDuplicates(["rep"]), what)


def runs(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by shingle, salt and size -> rows of shingles that several sets share, each with its pivot.

    A pivot serves the following sets of its run until they are too large for it. A row waits for the
    next one, to know whether its shingle is shared; nothing else is held.
    """
    last = None  # shingle, salt, rep, n, pivot, pivot's n, shared
    for f in frames:
        out: list[tuple] = []
        shingle, salt, rep, n = (f[c].to_numpy() for c in ("shingle", "salt", "rep", "n"))
        same = np.zeros(len(f), bool)
        same[1:] = (shingle[1:] == shingle[:-1]) & (salt[1:] == salt[:-1])
        if last is not None and len(f):
            same[0] = (last[0], last[1]) == (shingle[0], salt[0])
        # a row matters if it continues a run or the next row does, or if its salt hides sharers elsewhere
        near = same | np.append(same[1:], True) | (salt > 0)
        for k in np.flatnonzero(near):
            row = (int(shingle[k]), int(salt[k]), int(rep[k]), int(n[k]))
            if same[k] and last is not None:
                if not last[6]:
                    out.append(last[:3] + (last[3], last[4]))
                fits = 100 * last[5] >= percent * row[3]
                last = row + ((last[4], last[5]) if fits else (row[2], row[3])) + (True,)
                out.append(last[:5])
            else:
                last = row + (row[2], row[3], row[1] > 0)
                if row[1] > 0:
                    out.append(last[:5])
        if out:
            yield pd.DataFrame(out, columns=["shingle", "salt", "rep", "n", "pivot"])


def bounded(na: np.ndarray, nb: np.ndarray, a: list[bytes], b: list[bytes], percent: int) -> np.ndarray:
    """Whether the bitmaps of pairs (a[i], b[i]) leave room for the least overlap: overlap <= (na + nb - differing bits) / 2."""
    out = np.ones(len(a), bool)
    for i, (x, y) in enumerate(zip(a, b)):
        m = folded([x, y])
        out[i] = na[i] + nb[i] - int(np.bitwise_count(m[0] ^ m[1]).sum()) >= 2 * least_overlap(na[i], nb[i], percent)
    return out


def with_sides(pairs: DataFrame, sets: DataFrame, what: str) -> DataFrame:
    """Pairs (a, b) with n and what of both sides."""
    for k in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("rep").alias(k), F.col("n").alias(f"{k}_n"), F.col(what).alias(f"{k}_{what}")), k)
    return pairs


def bounded_pairs(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and bitmaps leave open."""

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = bounded(f["a_n"].to_numpy(), f["b_n"].to_numpy(), f["a_bits"].tolist(), f["b_bits"].tolist(), percent)
            yield f.loc[ok, ["a", "b"]]

    fits = f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"
    return with_sides(pairs, bits, "bits").where(fits).mapInPandas(bound, "a long, b long")


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sorted shingle arrays have the overlap that was asked for."""

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = np.zeros(len(f), bool)
            for i, (x, y) in enumerate(zip(f["a_shingles"], f["b_shingles"])):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both) and both > 0
            yield f.loc[ok, ["a", "b"]]

    return with_sides(pairs, sets, "shingles").mapInPandas(exact, "a long, b long")


def in_large(rows: DataFrame, joined: DataFrame) -> DataFrame:
    rows, mixed = with_components(rows, joined, LARGE)
    return rows.join(mixed, "shingle", "left_semi")


def open_pairs(spark: SparkSession, rows: DataFrame, joined: DataFrame, bits: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs from the smaller groups whose members belong to several components, less those that bitmaps rule out.

    A pair meets once in each small group that it shares, and prefixes of linked sets share the lesser of
    their two numbers at least; a pair that shares a large group has been decided there.
    """
    # two members have been compared with each other already
    rows, mixed = with_components(rows, joined, 3, LARGE - 1)
    rows = scratch.save(rows.join(mixed, "shingle", "left_semi"), "open")
    found = meetings(rows, bits.select("rep", "bits"), partitions(spark), percent).mapInPandas(lambda frames: met(frames, percent), "a long, b long, least long")
    found = found.groupBy("a", "b").agg(F.count("*").alias("met"), F.min("least").alias("least"))
    return found.where("met >= least").select("a", "b")


def meetings(rows: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows dealt to the meetings of tile rows, with what sets has of them, sorted by meeting.

    The rows of a shingle and band are dealt to tile rows of about TILE members; tile rows of the same
    and of neighbouring bands meet pairwise, each meeting in a group of its own.
    """
    rows = rows.withColumn("band", band(F.col("n"), percent))
    sizes = rows.groupBy("shingle", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("lots"))
    here = rows.join(sizes, ["shingle", "band"]).withColumn("lot", F.pmod(F.xxhash64("rep"), F.col("lots")).cast("int"))
    above = sizes.select("shingle", (F.col("band") - 1).alias("band"), F.col("lots").alias("above"))
    below = sizes.select("shingle", (F.col("band") + 1).alias("band"), F.col("lots").alias("below"))
    here = here.join(above, ["shingle", "band"], "left").join(below, ["shingle", "band"], "left")
    # meetings: (low band, low lot, high band, high lot); within a band lot x meets lots y >= x
    no = F.array().cast("array<struct<p:int,x:int,q:int,y:int>>")
    meet = lambda p, x, q, y: F.struct(p.alias("p"), x.cast("int").alias("x"), q.alias("q"), y.cast("int").alias("y"))
    lots = F.sequence(F.lit(0), F.col("lots") - 1)
    own = F.transform(lots, lambda y: meet(F.col("band"), F.least("lot", y), F.col("band"), F.greatest("lot", y)))
    up = F.when(F.col("above") > 0, F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda y: meet(F.col("band"), F.col("lot"), F.col("band") + 1, y))).otherwise(no)
    down = F.when(F.col("below") > 0, F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda x: meet(F.col("band") - 1, x, F.col("band"), F.col("lot")))).otherwise(no)
    here = here.join(sets, "rep").withColumn("meeting", F.explode(F.concat(own, up, down)))
    here = here.select("shingle", "meeting.*", "rep", "n", "component", *[c for c in sets.columns if c != "rep"], (F.col("band") * (1 << 20) + F.col("lot")).alias("side"))
    return here.repartition(n, *MEETING).sortWithinPartitions(*MEETING, "rep")


MEETING = ("shingle", "p", "x", "q", "y")


def met(frames: Iterator[pd.DataFrame], percent: int, decide: bool = False) -> Iterator[pd.DataFrame]:
    """Rows sorted by meeting -> pairs that bitmaps leave open, or, to decide, pairs that link. Only the meeting under way is held."""
    for f, starts in whole_groups(frames, *MEETING):
        n, c, ids, side, bits = (f[k].to_numpy() for k in ("n", "component", "rep", "side", "bits"))
        sets = [np.frombuffer(x, np.uint64) for x in f["shingles"]] if decide else None
        out: list[tuple] = []
        for start, end in zip(starts, np.append(starts[1:], len(f))):
            if end - start < 2 or (c[start:end] == c[start]).all():
                continue
            m, own = folded(bits[start:end].tolist()), c[start:end].copy()
            apart = (side[start:end] != side[start]).any()
            for i in range(start, end - 1):
                j = np.arange(i + 1, end)
                # pairs inside a tile row belong to its meeting with itself
                ok = (own[j - start] != own[i - start]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                j = j[ok & (side[j] != side[i]) if apart else ok]
                if len(j):
                    room = n[i] + n[j] - np.bitwise_count(m[j - start] ^ m[i - start]).sum(axis=1).astype(np.int64)
                    j = j[room >= 2 * least_overlap(n[i], n[j], percent)]
                if decide and len(j):
                    j = j[overlaps(sets[i], [sets[x] for x in j]) >= least_overlap(n[i], n[j], percent)]
                    # what is linked now needs no second look in this meeting
                    for x in j:
                        own[own == own[x - start]] = own[i - start]
                out += [(min(ids[i], ids[x]), max(ids[i], ids[x]), least_shared(min(n[i], n[x]))) for x in j]
        yield pd.DataFrame(out, columns=["a", "b", "least"], dtype=np.int64)


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted array with others."""
    every = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def near_duplicates(spark: SparkSession, docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 75) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_id (xxhash64 of the text), n_shingles, component and component_id, one row per input row.

    component names the group (null where a row can't be linked), component_id is the smallest id in it.
    """
    rows, joined = links(spark, docs, scratch, width, percent)
    found = rows.join(joined.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).drop("rep")
    found = scratch.save(found, "components")
    # a group named by a number beyond all ids, or by an id that is not its least one
    least = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members")).where("component_id != component")
    found = salted_join(found, scratch.save(least, "renamed"), "component", "members", F.col("text_id"))
    return found.withColumn("component_id", F.coalesce("component_id", "component", "doc_id")).select("doc_id", "text_id", "n_shingles", "component", "component_id")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)).select("doc_id", "n_shingles", "component_id")
