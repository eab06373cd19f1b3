"""Connected components of an edge table, with no star, edge list or label table on one machine.

Each round hooks every node to the least of its neighbours and itself, follows that pointer once more, and replaces the
edges' ends by what they point to. Edges within a component vanish as it shrinks to its least node; nodes that still have
edges at least halve. Rounds are written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import shared_dir, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b; long): label is the least node that it is connected to.

    Loops, repeats and both directions are allowed; rows with a null end are no edges. An empty table gives no rows.
    """
    where = shared_dir(edges.sparkSession)
    live = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{where}/edges-0")
    labels = stored(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")), f"{where}/labels-0")
    k = 0
    while not live.isEmpty():
        k += 1
        both = live.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        hook = stored(both.groupBy(F.col("a").alias("at")).agg(F.least(F.min("b"), F.col("at")).alias("to")), f"{where}/hook-{k}")
        far = hook.select(F.col("at").alias("to"), F.col("to").alias("further"))
        hook = stored(hook.join(far, "to").select("at", F.col("further").alias("to")), f"{where}/jump-{k}")
        new = follow(follow(live, hook, "a"), hook, "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        live = stored(new, f"{where}/edges-{k}")
        labels = stored(follow(labels, hook, "label"), f"{where}/labels-{k}")
    return labels


def follow(df: DataFrame, hook: DataFrame, col: str) -> DataFrame:
    """``col`` replaced by what it points to; itself where it has no pointer."""
    h = hook.select(F.col("at").alias(col), F.col("to").alias("__to"))
    return df.join(h, col, "left").withColumn(col, F.coalesce("__to", col)).drop("__to").select(*df.columns)
