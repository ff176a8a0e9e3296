"""Shared helpers: tables, the shared folder, sized joins and distributed running totals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: One word of the contracts: a run of anything but space, tab, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of a join is broadcast only if it was counted and has at most this many rows, and bytes as JSON.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a folder in the warehouse, but on a cluster only if the warehouse is no folder of one machine.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root
    home = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local = "://" not in home and home.startswith(("/", "file:")) or home.startswith("file:")
    if local and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; {home} may be one machine's")
    return f"{home}/_shared"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts its lineage.

    The table outlives a lost executor. It stays until the owner of spark.checkpoint.dir clears that folder.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(nullable(df.schema)).parquet(path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def running(xs: Column, zero: Column, step, join, block: int = 256) -> Column:
    """For each element of an array, the fold of the elements before it.

    The array is folded in blocks, and the folds of the blocks are folded by ``join``: a growing array is copied for each
    element within a block only, so that the time is linear in all but very long arrays.
    """

    def scan(values: Column, start: Column, f) -> Column:
        first = F.struct(start.alias("at"), F.slice(F.array(start), F.lit(1), F.lit(0)).alias("out"))
        return F.aggregate(values, first, lambda a, x: F.struct(f(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    cuts = F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(block))
    blocks = F.transform(cuts, lambda c: F.slice(xs, c + 1, F.lit(block)))
    before = scan(F.transform(blocks, lambda b: F.aggregate(b, zero, step)), zero, join)
    return F.flatten(F.zip_with(blocks, before, lambda b, start: scan(b, start, step)))


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df may be broadcast: few rows, and few bytes where it has more than a thousand."""
    rows = df.count()
    if rows > limit:
        return False
    if rows <= 1000:
        return True
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= BROADCAST_BYTES


def join_bounded(left: DataFrame, right: DataFrame, key: str, how: str = "left", spread: int = 32, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a large side with one row per key of a side whose size is checked.

    Up to ``limit`` rows and BROADCAST_BYTES the right side is broadcast. Beyond it the left side's keys are salted over ``spread`` parts, so
    that a key with a third of all rows does not meet in one task. Null keys match each other.
    """
    right = right.withColumnRenamed(key, "_rk")
    match = F.col(key).eqNullSafe(F.col("_rk"))
    if is_small(right, limit):
        return left.join(F.broadcast(right), match, how).drop("_rk")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(spread)).cast("int"))
    copies = right.withColumn("_rsalt", F.explode(F.array(*[F.lit(i) for i in range(spread)])))
    # The planner takes the size of the files for that of the rows, and would broadcast a side that was found too large.
    return salted.join(copies.hint("merge"), match & (F.col("_salt") == F.col("_rsalt")), how).drop("_rk", "_salt", "_rsalt")


def bucketed_totals(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds the exclusive running sum of ``value`` within ``group``, ordered by ``bucket`` and then ``order``.

    A hot group is spread over its buckets: each (group, bucket) is summed by itself, and the few bucket sums are summed
    again. ``bucket`` must follow from the row alone, so that a lost task gives the same result when it runs again.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    for k in keys:
        offsets = offsets.withColumnRenamed(k, f"_o_{k}")
    on = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    return local.join(offsets, on).withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", *[f"_o_{k}" for k in keys])
