"""Session helpers: shared scratch space, partition counts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of the Arrow batches that Python stages get, where the session sets no bound of its own.
ARROW_BYTES = 8 << 20
#: Rows up to which a narrow side (ids, counters) may be broadcast.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where it is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return shared_dir.own


def bound_batches(spark: SparkSession) -> None:
    """Bound what Python stages hold at once by bytes: rows alone do not bound it where texts are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ARROW_BYTES))


class Scratch:
    """Tables written to the shared folder to cut lineage; lost executors never lose them."""

    def __init__(self, spark: SparkSession):
        bound_batches(spark)
        self.spark = spark
        self.named: list[str] = []
        self.root = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
        """df written in buckets of keys: joins on these read it where it lies, however often they come."""
        table = f"corpusloom_{uuid.uuid4().hex}"
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", self.path(name)).saveAsTable(table)
        self.named.append(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))

    def close(self) -> None:
        """Delete everything; only for tables that nothing reads any more."""
        for table in self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(self.spark, self.root)


def clear_ended(spark: SparkSession, ended: set[str]) -> int:
    """Delete the scratch tables of applications that have ended, named by their ids; returns how many had any."""
    jvm, base = spark.sparkContext._jvm, shared_dir(spark)
    own = spark.sparkContext.applicationId
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = [jvm.org.apache.hadoop.fs.Path(f"{base}/scratch-{a}") for a in sorted(ended - {own})]
    return sum(bool(fs.delete(p, True)) for p in paths)


def running_sum(rows: DataFrame, value: str, at: str, *by: str, step: int = 4096) -> DataFrame:
    """rows with upto: the sum of value over rows of the same by with a smaller at.

    rows is read twice, so it should be a written table; at is a whole number, not negative, and unique within by.
    Sums run inside stretches of step places, then over the stretches: no task holds all rows of a by.
    """
    rows = rows.withColumn("_stretch", F.floor(F.col(at) / step))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    stretches = rows.groupBy(*by, "_stretch").agg(F.sum(value).alias("_sum"))
    base = F.sum("_sum").over(before.partitionBy(*by).orderBy("_stretch"))
    stretches = stretches.select(*by, "_stretch", F.coalesce(base, F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(value).over(before.partitionBy(*by, "_stretch").orderBy(at)), F.lit(0))
    return rows.withColumn("upto", inside).join(stretches, [*by, "_stretch"]).withColumn("upto", F.col("upto") + F.col("_base")).drop("_stretch", "_base")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession, rows: int = 0, per_task: int = 1_000_000) -> int:
    """Shuffle partitions: the session's number, or more where rows ask for more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast only if its known row count is within the limit."""
    return F.broadcast(df) if rows <= limit else df


def dealt_out(df: DataFrame) -> DataFrame:
    """df, marked to be dealt over the tasks of a join: names and ids take thirty times their size in files once they are broadcast."""
    return df.hint("merge")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def salted_join(left: DataFrame, right: DataFrame, key: str, rows: str, spread: Column, per: int = 100_000) -> DataFrame:
    """Left join where a key may hold a third of left's rows.

    right has one row per key, with left's number of rows in the column rows. Keys of more than per rows
    are repeated in right and left's rows are dealt over the repeats by spread.
    """
    lots = F.greatest(F.lit(1), F.least(F.lit(512), F.floor(F.col(rows) / per))).cast("int")
    wide = right.where(F.col(rows) >= 2 * per).select(key, lots.alias("_lots"))
    dealt = left.join(wide, key, "left").withColumn("_lot", F.pmod(F.xxhash64(spread), F.coalesce("_lots", F.lit(1))).cast("int")).drop("_lots")
    spread_out = right.withColumn("_lot", F.explode(F.sequence(F.lit(0), lots - 1)))
    return dealt.join(spread_out, [key, "_lot"], "left").drop("_lot", rows)
