"""Vector products and normalisations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import Scratch, small

#: Values of a group up to which one task may hold them.
HELD = 100_000
#: Cuts of a narrowing step, and the accuracy with which they are found: far finer than the cuts.
CUTS, ACCURACY = 500, 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once, however often f and its lambdas use it."""
    return F.transform(F.array(x), f)[0]


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    scaled = lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x))
    return bound(bound(v, lambda a: F.struct(a.alias("v"), F.sqrt(dot(a, a)).alias("n"))), scaled)


def mean_vector(v: Column) -> Column:
    """Aggregate: the mean of arrays, added up where they lie, before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))


def masked_mean(vectors: Column, counts: Column) -> Column:
    """The mean of those of an array of vectors whose count is not 0; zeros if none is, null if there are no vectors at all."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), counts.alias("n")), lambda t: t["n"] != 0), lambda t: t["v"])
    zeros = F.transform(vectors[0], lambda x: F.lit(0.0))
    total = lambda own: F.aggregate(own, zeros, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.when(F.size(vectors) > 0, bound(kept, lambda own: bound(total(own), lambda t: F.transform(t, lambda x: x / F.greatest(F.size(own), F.lit(1))))))


def beside(df: DataFrame, by: tuple, **aggregates: Column) -> DataFrame:
    """df with aggregates over the rows of the same by: a small table joined back, instead of a window that sorts each group in one task."""
    if by:
        return df.join(df.groupBy(*by).agg(*[a.alias(n) for n, a in aggregates.items()]), list(by))
    return df.withColumns({n: df.agg(a.alias(n)).scalar() for n, a in aggregates.items()})


def min_max(df: DataFrame, x: str, *by: str, to: str = "score") -> DataFrame:
    """df with x brought to 0..1 within by; all 1 where all are equal."""
    span = F.col("_high") - F.col("_low")
    scaled = F.when(span == 0, 1.0).otherwise((F.col(x) - F.col("_low")) / span)
    return beside(df, by, _low=F.min(x), _high=F.max(x)).withColumn(to, scaled).drop("_low", "_high")


def quantiles(rows: DataFrame, x: str, by: tuple[str, ...], at: tuple[float, ...], held: int = HELD) -> DataFrame:
    """(by..., q0, q1, ...): exact quantiles of x within by, interpolated as percentile does; rows should be a written table.

    Groups of up to held values are sorted in one task. In larger ones each order statistic that is asked for is
    closed in: cuts of equal depth, found with bounded state, and a count of the values below and between two
    of them leave a fiftieth or less of the values each time, until held of them are left or one value.
    All groups take part in each pass over the table. Nulls of x are left out; by must not be null.
    """
    rows = rows.select(*by, F.col(x).cast("double").alias("_x")).where("_x is not null")
    sizes = Scratch(rows.sparkSession).save(rows.groupBy(*by).agg(F.count("*").alias("n")), "sizes")
    exact = lambda df: df.groupBy(*by).agg(*[F.percentile("_x", F.lit(q)).alias(f"q{k}") for k, q in enumerate(at)])
    large = sizes.where(F.col("n") > held)
    if large.isEmpty():
        return exact(rows)
    if by:
        found = narrowed(rows.join(small(large.drop("n"), large.count()), list(by), "left_semi"), large, by, at, held)
        return exact(rows.join(small(large.drop("n"), large.count()), list(by), "left_anti")).unionByName(found)
    return narrowed(rows.withColumn("_all", F.lit(0)), large.withColumn("_all", F.lit(0)), ("_all",), at, held).drop("_all")


def narrowed(rows: DataFrame, sizes: DataFrame, by: tuple[str, ...], at: tuple[float, ...], held: int) -> DataFrame:
    """Quantiles of the groups in sizes(by..., n). A target is the value at place j of a group, between low and high, with below values up to low."""
    scratch, key = Scratch(rows.sparkSession), [*by, "j"]
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(f(place(q)).cast("long")) for q in at for f in (F.floor, F.ceil)])))
    open_now = sizes.select(*by, F.explode(wanted).alias("j"), F.col("n").alias("inside"), F.lit(0).cast("long").alias("below"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    open_now, done, turn = scratch.save(open_now, "targets"), [], 0

    def within(targets: DataFrame) -> DataFrame:
        return rows.join(small(targets, targets.count()), list(by)).where((F.col("_x") > F.col("low")) & (F.col("_x") < F.col("high")))

    while not (wide := open_now.where(F.col("inside") > held)).isEmpty():
        cuts = within(wide).groupBy(*key).agg(F.percentile_approx("_x", [k / CUTS for k in range(CUTS + 1)], ACCURACY).alias("cuts"))
        nth = F.floor((F.col("j") - F.col("below")) / F.col("inside") * CUTS).cast("int")
        cut = lambda k: F.element_at("cuts", 1 + F.greatest(F.lit(0), F.least(F.lit(CUTS), nth + k)))
        tried = scratch.save(wide.join(cuts, key).select(*key, "inside", "below", "low", "high", cut(-1).alias("a"), cut(2).alias("b")), f"tried-{turn}")
        v = F.col("_x")
        counts = within(tried).groupBy(*key).agg(*[F.count_if(c).alias(n) for n, c in (("under", v < F.col("a")), ("at_a", v == F.col("a")), ("at_b", v == F.col("b")), ("up_to", v <= F.col("b")))])
        t = scratch.save(tried.join(counts, key), f"counted-{turn}")
        nth = F.col("j") - F.col("below")
        value = F.when((nth >= F.col("under")) & (nth < F.col("under") + F.col("at_a")), F.col("a")).when((nth >= F.col("up_to") - F.col("at_b")) & (nth < F.col("up_to")), F.col("b"))
        # cuts that miss the place, which their accuracy rules out, leave one side open
        left, right = nth >= F.col("under") + F.col("at_a"), nth < F.col("up_to") - F.col("at_b")
        skipped, kept = F.when(left, F.col("under") + F.col("at_a")).otherwise(0), F.when(right, F.col("up_to") - F.col("at_b")).otherwise(F.col("inside"))
        step = t.select(*key, value.alias("value"), (kept - skipped).alias("inside"), (F.col("below") + skipped).alias("below"), F.when(left, F.col("a")).otherwise(F.col("low")).alias("low"), F.when(right, F.col("b")).otherwise(F.col("high")).alias("high"))
        step = scratch.save(step, f"step-{turn}")
        done.append(step.where("value is not null").select(*key, "value"))
        open_now = scratch.save(step.where("value is null").drop("value").unionByName(open_now.where(F.col("inside") <= held)), f"open-{turn}")
        turn += 1
    last = within(open_now).groupBy(*key, "below").agg(F.array_sort(F.collect_list("_x")).alias("v"))
    values = last.select(*key, F.element_at("v", (F.col("j") - F.col("below") + 1).cast("int")).alias("value"))
    for d in done:
        values = values.unionByName(d)
    values = scratch.save(values, "values").groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("j", "value"))).alias("at"))
    both = values.join(sizes, list(by))
    one = lambda q: F.element_at("at", F.floor(place(q)).cast("long")) * (1 - place(q) + F.floor(place(q))) + F.element_at("at", F.ceil(place(q)).cast("long")) * (place(q) - F.floor(place(q)))
    return both.select(*by, *[one(q).alias(f"q{k}") for k, q in enumerate(at)])


def truncated_min_max(df: DataFrame, x: str, *by: str, lo: float = 0.01, hi: float = 0.99, to: str = "norm", held: int = HELD) -> DataFrame:
    """df with x between two exact quantiles within by, clipped to 0..1; 0.5 where these are equal. df is written first."""
    df = Scratch(df.sparkSession).save(df, "valued")
    found = quantiles(df, x, by, (lo, hi), held).withColumnsRenamed({"q0": "_low", "q1": "_high"})
    low, high = F.col("_low"), F.col("_high")
    scaled = F.when(high <= low, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(x) - low) / (high - low))))
    joined = df.join(found, list(by)) if by else df.withColumns({c: found.select(c).scalar() for c in ("_low", "_high")})
    return joined.withColumn(to, scaled).drop("_low", "_high")
