"""Texts by key: a table laid out so that a page of hits reads the few row groups that hold its texts.

Rows are range-partitioned and sorted by a number made from the path, in row groups of their own size, with a Parquet Bloom
filter on that number. A lookup pushes the page's keys to the scan: statistics and the filter of a row group tell whether
any of them can be in it, so what is read grows with the page and not with the table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contents import path_hash

#: Bytes of a row group, and rows of the largest page whose keys are pushed down; a larger one is a join.
GROUP_BYTES, PAGE = 1 << 20, 1000
#: Rows that the Bloom filter of a row group is made for.
GROUP_ROWS = 20_000


def key_of(path: str) -> int:
    """What ``contents.path_hash`` gives for a path."""
    return int(hashlib.sha256(path.encode()).hexdigest()[:15], 16)


def rows(docs: DataFrame, most: int | None = None) -> DataFrame:
    """(key, path, content, bytes, cut) of documents (path, content), one for each path; of repeated paths the largest text
    stays. Null paths have no row. With ``most`` a text is stored up to that many characters and ``cut`` tells so; bytes are
    those of the whole text."""
    text = F.coalesce("content", F.lit(""))
    longer = F.lit(False) if most is None else F.length(text) > most
    kept = text if most is None else F.substring(text, 1, most)
    once = docs.filter(F.col("path").isNotNull()).groupBy("path").agg(F.max("content").alias("content"))
    return once.select(path_hash(F.col("path")).alias("key"), "path", kept.alias("content"), F.octet_length(text).cast("long").alias("bytes"), longer.alias("cut"))


def write(docs: DataFrame, where: str, most: int | None = None, group_bytes: int = GROUP_BYTES) -> None:
    """Writes the table of texts; ``docs`` has unique paths or repeated ones (see ``rows``)."""
    (
        rows(docs, most).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite")
        .option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", 1000)
        .option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", GROUP_ROWS)
        .parquet(where)
    )


def any_of(column: Column, values: list[int]) -> Column:
    """Whether a column is one of the values, as a balanced tree of equalities: each of them reaches the scan, whereas a long
    list would reach it as its smallest and largest value only."""
    if not values:
        return F.lit(False)
    tests = [column == F.lit(v) for v in values]
    while len(tests) > 1:
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0]


def lookup(spark: SparkSession, where: str, paths: list[str]) -> DataFrame:
    """(key, path, content, bytes, cut) of the stored texts of some paths; paths that are not stored have no row."""
    wanted = sorted(set(paths))
    return spark.read.parquet(where).filter(any_of(F.col("key"), sorted({key_of(p) for p in wanted})) & F.col("path").isin(wanted))


def with_texts(page: DataFrame, where: str, most: int = PAGE) -> DataFrame:
    """The rows of a page of hits (path and any columns but those of a text) with content, bytes and cut, null where no text
    is stored. Up to ``most`` paths are brought to the driver and pushed to the scan as keys; a larger page joins on the
    key, with the same rows."""
    spark = page.sparkSession
    found = page.select("path").filter(F.col("path").isNotNull()).distinct().limit(most + 1).collect()
    texts = spark.read.parquet(where) if len(found) > most else lookup(spark, where, [r.path for r in found])
    keyed = page.withColumn("__key", path_hash(F.col("path")))
    stored = texts.select(F.col("key").alias("__key"), "path", "content", "bytes", "cut")
    return keyed.join(stored, ["__key", "path"], "left").select(*page.columns, "content", "bytes", "cut")
