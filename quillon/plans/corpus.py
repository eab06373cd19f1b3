"""Tables as document relations: the columns that plans search and show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship

EPOCH = 1_704_067_200
#: Rows and bytes of a batch between Spark and Python, with Spark's own: a worker holds a few times as much as a batch.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1024"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864", "4194304"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. A session that has Spark's own sizes of batches gets smaller ones; those that were set stay."""
    ship(spark)
    for key, own, smaller in BATCHES:
        if (spark.conf.get(key, None) or "").rstrip("b") == own:
            spark.conf.set(key, smaller)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_paths(df: DataFrame) -> DataFrame:
    """Adds parent, dir, name, name_lc and ext to a table with paths."""
    return (
        df.withColumn("parent", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
        .withColumn("dir", F.concat("parent", F.lit("/"))).withColumn("name_lc", F.lower("name")).withColumn("ext", T.extension(F.col("name")))
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table in the engine's schema. Columns that a query does not use are never computed."""
    raw = table(spark, sf_dir, "documents")
    df = raw.select(
        "doc_id", F.concat(F.lit("/corpus/"), F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit("text").alias("kind"), F.octet_length("text").cast("long").alias("size"), (F.lit(EPOCH) + F.col("doc_id") * 3600).alias("mtime"), F.col("text").alias("content"),
        F.lit("").alias("meta"), F.lit(0).cast("long").alias("flags"),
    )
    return with_paths(df)
