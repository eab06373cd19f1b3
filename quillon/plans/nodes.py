"""A node of one's own for the query language, as an example and for use: words at the start of a field."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as T


class Begins(Q.Own):
    """``begins:"of the"``: the first words of a field, whole. A value without words matches nothing."""

    weight = 2.0

    def condition(self, fields: tuple) -> Column:
        words = T.query_tokens(self.value)
        start = F.lit(f" {' '.join(words)} ")
        return reduce(or_, [F.startswith(F.col(f"__{f}"), start) for f in fields]) if words else F.lit(False)

    def rows(self, index) -> DataFrame:
        words = T.query_tokens(self.value)
        if not words:
            return index.posts.filter(F.lit(False)).select("doc_id", "field", "tf")
        at = [index.posts.filter((F.col("term") == w) & F.array_contains("positions", k)).select("doc_id", "field") for k, w in enumerate(words)]
        return reduce(lambda a, b: a.join(b, ["doc_id", "field"]), at).withColumn("tf", F.lit(1))


Q.register("begins", Begins)
