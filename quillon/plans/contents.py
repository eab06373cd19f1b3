"""A content-addressed index: equal texts are stored and tokenised once, whatever files they are in.

Tables of a store, which grow by segments: ``texts`` (hash, text_no), ``members`` (doc_id, text_no) and ``postings`` of the
texts, whose doc_id is the number of the text. A text's number is that of the first document that brought it. A copy, or a
file that was touched and says what it said before, adds a row to ``members`` and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Store
from . import index as I


def content_hash(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, in lower-case hex; that of the empty text for null."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def path_hash(path: Column) -> Column:
    """A number for a path, the same in every run: the first 60 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(path.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def copies(docs: DataFrame) -> DataFrame:
    """(hash, first, n) of each text: the smallest doc_id that has it, and how many have it. Only hashes are shuffled."""
    return docs.select("doc_id", content_hash(F.col("content")).alias("hash")).groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


class Contents:
    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.store = spark, Store(spark, where)

    def add(self, docs: DataFrame) -> int:
        """Adds documents (doc_id, content), whose numbers are new; returns how many texts were tokenised.

        Texts are read once to hash them; only those that no document had before are read again. Null and empty texts are one
        text without postings.
        """
        keyed = self.spark.read.parquet(self.store.draft("hashes", docs.select("doc_id", content_hash(F.col("content")).alias("hash"))))
        known = self.store.table("texts")
        fresh = keyed.groupBy("hash").agg(F.min("doc_id").alias("text_no"))
        if known is not None:
            fresh = fresh.join(known.select("hash"), "hash", "left_anti")
        fresh = self.spark.read.parquet(self.store.draft("texts", fresh))
        numbers = fresh if known is None else fresh.unionByName(known)
        members = keyed.join(numbers, "hash").select("doc_id", "text_no")
        texts = docs.select("doc_id", "content").join(fresh.select(F.col("text_no").alias("doc_id")), "doc_id", "left_semi")
        posts = self.spark.read.parquet(self.store.draft("gathered", I.postings(texts, ("content",))))
        posts = posts.repartitionByRange(I.ranges(posts), "term", "doc_id").sortWithinPartitions("term", "doc_id")
        new = {"texts": self.store.drafted("texts"), "members": self.store.draft("members", members), "postings": self.store.draft("postings", posts)}
        self.store.commit(keep={name: len(self.store.segments(name)) for name in new}, **new)
        return fresh.count()

    def index(self, docs: DataFrame) -> I.Index:
        """An index of ``docs`` (doc_id, name, ...) over the texts' postings and the documents' own names. A term is looked up
        among the texts first and then taken to the documents that share them."""
        posts = self.store.table("postings").withColumnRenamed("doc_id", "text_no").join(self.store.table("members"), "text_no").drop("text_no")
        return I.Index(docs, posts.unionByName(I.postings(docs, ("name",)), allowMissingColumns=True))
