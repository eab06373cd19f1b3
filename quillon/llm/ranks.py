"""Places of rows in a total order, without one task that sees them all.

Rows are dealt to ranges of the order, sorted there and written; each row keeps its number within its range. What came
before a range is then a sum over ranges, of which there are as many as shuffle partitions, not as many as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import stored


def ranked(df: DataFrame, group: str, order: list[str], where: str) -> DataFrame:
    """``df`` with g (number of the row's group, in the order of its values, null first), rank (its place within the group,
    from 0, by ``order``) and total (rows of the group).

    Groups may be of any size and number: a range of rows holds the end of one group and the start of another at most.
    Rows that are equal in group and order get places in an order of their own. The sorted rows are written under ``where``.
    """
    rows = stored(df.repartitionByRange(F.col(group).asc_nulls_first(), *order).sortWithinPartitions(F.col(group).asc_nulls_first(), *order).withColumn("__at", F.monotonically_increasing_id()), where)
    rows = rows.withColumn("__shard", F.shiftright("__at", 33))
    parts = rows.groupBy("__shard", F.col(group).alias("__group")).agg(F.min("__at").alias("__start"), F.count("*").alias("__n"))
    same = Window.partitionBy("__group")
    before = F.coalesce(F.sum("__n").over(same.orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("__before", before).withColumn("total", F.sum("__n").over(same)).withColumn("__new", (F.col("__before") == 0).cast("long"))
    # one row for each shuffle partition
    shards = parts.groupBy("__shard").agg(F.sum("__new").alias("__starts"))
    shards = shards.select("__shard", F.coalesce(F.sum("__starts").over(Window.orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    place = F.sum("__new").over(Window.partitionBy("__shard").orderBy("__start")) - 1
    parts = parts.withColumn("__place", place).join(shards, "__shard").select(F.col("__shard").alias("__s"), "__group", "__start", "__before", "total", (F.col("__base") + F.col("__place")).alias("g"))
    parts = stored(parts, f"{where}-parts")
    joined = rows.join(parts, (F.col("__shard") == F.col("__s")) & F.col(group).eqNullSafe(F.col("__group")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], "g", (F.col("__at") - F.col("__start") + F.col("__before")).alias("rank"), "total")
