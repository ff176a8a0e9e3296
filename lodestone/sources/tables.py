"""The corpus, read from Parquet tables in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a folder in the warehouse, but on a cluster only if the warehouse is no folder of one machine.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root
    home = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if (home.startswith("file:") or "://" not in home) and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; {home} may be one machine's")
    return f"{home}/_shared"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by checkpoint(), in the shared folder."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question, qvec: the benchmark items that have a vector by id."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("qvec"))
    return items.join(vectors, "question_id")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A corpus before and after a crawl: prior (source_id, url, hash, tombstoned) and incoming (source_id, url, hash).

    Documents with ids that 10 divides are gone, those that 7 divides are changed, and those that 11 divides are new or back.
    """
    d = table(spark, sf_dir, "documents")
    base = d.select(F.col("source").alias("source_id"), F.concat(F.lit("https://docs.example.org/"), F.col("doc_id").cast("string")).alias("url"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "doc_id")
    prior = base.filter((F.col("doc_id") % 11 != 0) | (F.col("doc_id") % 2 == 0)).select("source_id", "url", "hash", (F.col("doc_id") % 11 == 0).alias("tombstoned"))
    incoming = base.filter(F.col("doc_id") % 10 != 0).select("source_id", "url", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("hash", F.lit("x")), 256)).otherwise(F.col("hash")).alias("hash"))
    return prior, incoming


def load_snapshot(spark: SparkSession, path: str, schema: str, defaults: dict[str, object]) -> DataFrame:
    """A JSON snapshot file (one value, or an array of rows) with the defaults of fields that are missing or null."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(*[F.coalesce(F.col(c), F.lit(defaults[c]).cast(rows.schema[c].dataType)).alias(c) if c in defaults else F.col(c) for c in rows.columns])
