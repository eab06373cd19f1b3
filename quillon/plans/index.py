"""The inverted index as tables, and queries over it.

postings(field, term, doc_id, tf, positions) is sorted by term within ranges, so that a term or prefix reads few row groups.
A query becomes one aggregation over the postings of its leaves: a flag and a score for each leaf and document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as T
from .scan import FIELDS, LEAST_PREFIX, LEAST_WRITTEN, field_condition

K1, B = 1.2, 0.75
BOOSTS = {"content": 1.0, "name": 3.0, "meta": 1.5}
PHRASE_BOOST = 2.0
#: Bytes of the files of a range that is sorted by one task; rows in memory take some twenty times as many.
RANGE_BYTES = 16 << 20


def tokenised(df: DataFrame, fields: tuple = FIELDS) -> DataFrame:
    """(doc_id, field, tokens) of the texts that are not empty."""
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("t")) for f in fields])
    each = df.select("doc_id", F.explode(texts).alias("x")).select("doc_id", "x.field", "x.t").filter("t <> ''")
    return each.select("doc_id", "field", T.tokens(F.col("t")).alias("tokens"))


def gathered(df: DataFrame, fields: tuple = FIELDS) -> DataFrame:
    """(field, term, doc_id, tf, positions) of each text by itself, without a shuffle; an Arabic word stands without its
    article as well, at its place."""
    src = tokenised(df, fields)
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield by_word(part)

    return src.mapInArrow(run, f"field string, term string, doc_id {kind}, tf int, positions array<int>")


def parts(batch: pa.RecordBatch, column: str = "tokens", most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` tokens; a longer text is a part of its own."""
    start = total = 0
    for i, n in enumerate(pc.list_value_length(batch.column(column)).to_pylist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def by_word(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The words of each row (doc_id, field, tokens) with their positions."""
    sizes = pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = batch.column("tokens").flatten().dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    number = {w: k for k, w in enumerate(words)}
    second = np.array([number.setdefault(T.without_article(w), len(number)) if T.is_arabic(w) else k for k, w in enumerate(words)], np.int64)
    more = np.flatnonzero(second[code] != code)  # words that stand under a second form
    row, pos, code = (np.concatenate(x) for x in ((row, row[more]), (pos, pos[more]), (code, second[code[more]])))
    key = row * len(number) + code
    order = np.lexsort((pos, key)) if len(more) else np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    tf, of, word = np.diff(first, append=len(key)), row[order[first]], code[order[first]]
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(pos[order], pa.int32()))
    terms = pa.array(list(number), pa.string()).take(pa.array(word))
    return pa.RecordBatch.from_arrays([batch.column("field").take(pa.array(of)), terms, batch.column("doc_id").take(pa.array(of)), pa.array(tf, pa.int32()), positions], names=["field", "term", "doc_id", "tf", "positions"])


def postings(df: DataFrame, fields: tuple = FIELDS) -> DataFrame:
    """One row for each field, term and document. A document's words are gathered where its text is. Only where several rows
    have one doc_id, of which a look at that column tells, their postings are shuffled and put together."""
    rows = gathered(df, fields)
    if df.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy("field", "term", "doc_id").agg(F.sum("tf").cast("int").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def lengths(posts: DataFrame) -> DataFrame:
    return posts.groupBy("field", "doc_id").agg(F.sum("tf").alias("n"))


def term_stats(posts: DataFrame) -> DataFrame:
    """(field, term, df, cf): documents and occurrences of each term."""
    return posts.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def term_counts(df: DataFrame, fields: tuple = FIELDS) -> DataFrame:
    """The same straight from documents."""
    return term_stats(postings(df, fields))


def write(df: DataFrame, where: str, partitions: int | None = None) -> None:
    """Writes postings (ranges of terms, sorted), lengths and field statistics under ``where``. Postings are written once before
    they are dealt to ranges, so that texts are read once and ranges have a size that sorts in memory."""
    spark = df.sparkSession
    postings(df).write.mode("overwrite").parquet(f"{where}/gathered")
    rows = spark.read.parquet(f"{where}/gathered")
    n = partitions or ranges(rows)
    rows.repartitionByRange(n, "field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id").write.mode("overwrite").parquet(f"{where}/postings")
    posts = spark.read.parquet(f"{where}/postings")
    lengths(posts).write.mode("overwrite").parquet(f"{where}/lengths")
    field_stats(spark.read.parquet(f"{where}/lengths")).write.mode("overwrite").parquet(f"{where}/fields")


def ranges(rows: DataFrame) -> int:
    """Ranges for a written table: about RANGE_BYTES of its files each, or as many as the session has shuffle partitions."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))


class Index:
    """Written or in-memory tables of an index together with the documents' narrow columns."""

    def __init__(self, docs: DataFrame, posts: DataFrame, length: DataFrame | None = None, fields: DataFrame | None = None):
        self.docs, self.posts, self.length = docs, posts, length if length is not None else lengths(posts)
        self.fields = fields if fields is not None else field_stats(self.length)

    @classmethod
    def open(cls, docs: DataFrame, where: str) -> Index:
        read = docs.sparkSession.read
        return cls(docs, *(read.parquet(f"{where}/{t}") for t in ("postings", "lengths", "fields")))

    def leaf(self, node, whole_word: bool = False) -> DataFrame | None:
        """(doc_id, field, tf) of the documents that a leaf matches; None for a leaf without tokens. tf of a word being typed
        is that of the very word, zero where only longer ones were met."""
        words = T.query_tokens(node.text)
        if not words:
            return None
        last, prefix = last_of(node, words, whole_word)
        if len(words) == 1:
            hit = self.posts.filter(last).select("doc_id", "field", F.when(F.col("term") == words[0], F.col("tf")).otherwise(0).alias("tf"))
            return hit.groupBy("doc_id", "field").agg(F.sum("tf").alias("tf")) if prefix else hit
        out = None
        for k, w in enumerate(words):
            hit = self.posts.filter(last if k == len(words) - 1 else F.col("term") == w)
            at = hit.select("doc_id", "field", F.explode("positions").alias("p")).select("doc_id", "field", (F.col("p") - k).alias("p")).distinct()
            out = at if out is None else out.join(at, ["doc_id", "field", "p"])
        return out.groupBy("doc_id", "field").agg(F.count("*").alias("tf"))

    def _hits(self, leaves: list, whole_word: bool) -> DataFrame:
        """(leaf, doc_id, field, tf) of all leaves; the postings of single words are read once for all of them."""
        words = {k: T.query_tokens(n.text) for k, n in leaves if not isinstance(n, Q.Own)}
        single = [(k, *last_of(n, words[k], whole_word)) for k, n in leaves if len(words.get(k, ())) == 1]
        parts = []
        if single:
            own = {k: F.col("term") == words[k][0] for k, *_ in single}
            marks = F.filter(F.array(*[F.when(hit, F.struct(F.lit(k).alias("leaf"), F.when(own[k], F.col("tf")).otherwise(0).alias("tf"))) for k, hit, _ in single]), lambda x: x.isNotNull())
            rows = self.posts.filter(reduce(or_, [hit for _, hit, _ in single])).select("doc_id", "field", F.explode(marks).alias("m")).select("m.leaf", "doc_id", "field", "m.tf")
            parts.append(rows.groupBy("leaf", "doc_id", "field").agg(F.sum("tf").alias("tf")) if any(prefix for *_, prefix in single) else rows)
        for k, n in leaves:
            if len(words.get(k, ())) != 1:
                parts.append((n.rows(self) if isinstance(n, Q.Own) else self.leaf(n, whole_word)).select(F.lit(k).alias("leaf"), "doc_id", "field", "tf"))
        return reduce(DataFrame.unionByName, parts)

    def _compiled(self, query: str, whole_word: bool, now) -> tuple[object, Column | None, list]:
        """The tree, its condition on the leaves of a document (__leaves), and the leaves that have tokens, numbered."""
        node, leaves = Q.parse(query, now), []

        def build(n) -> Column | None:
            if isinstance(n, (Q.And, Q.Or)):
                parts = [c for c in map(build, n.parts) if c is not None]
                return reduce(and_ if isinstance(n, Q.And) else or_, parts) if parts else None
            if isinstance(n, Q.Not):
                inner = build(n.part)
                return None if inner is None else ~inner
            if isinstance(n, Q.Field):
                return field_condition(n)
            if not isinstance(n, Q.Own) and not T.query_tokens(n.text):
                return None
            leaves.append((len(leaves), n))
            return F.coalesce(F.array_contains("__leaves", len(leaves) - 1), F.lit(False))

        return node, build(node) if node is not None else None, leaves

    def matches(self, query: str, whole_word: bool = False, now=None) -> DataFrame:
        """(doc_id) of the documents that a query matches."""
        node, cond, leaves = self._compiled(query, whole_word, now)
        if cond is None or not leaves:
            return (self.docs if cond is None else self.docs.filter(cond)).select("doc_id")
        flags = self._hits(leaves, whole_word).groupBy("doc_id").agg(F.collect_set("leaf").alias("__leaves"))
        return self.docs.join(flags, "doc_id", "inner" if positive(node) else "left").filter(cond).select("doc_id")

    def scored(self, query: str, boosts: dict = BOOSTS, whole_word: bool = False, now=None) -> DataFrame:
        """(doc_id, score) of the documents that a query matches.

        A score is the BM25 of the leaves that are not under NOT, summed over fields by their boosts; a phrase counts double.
        Document frequency is that of the leaf in the field. A word being typed scores one for each field in which it begins a
        word, and as a word of its own besides, so that whole words come first. A boost of zero leaves the field out. One
        aggregation by document gives its leaves and its score.
        """
        node, cond, leaves = self._compiled(query, whole_word, now)
        if cond is None or not leaves:
            return (self.docs if cond is None else self.docs.filter(cond)).select("doc_id", F.lit(0.0).alias("score"))
        good = set(map(id, Q.leaves(node, (Q.Term, Q.Phrase, Q.Own))))
        weight = F.coalesce(F.create_map(*[F.lit(x) for k, v in boosts.items() for x in (k, float(v))])[F.col("field")], F.lit(0.0))
        double = [k for k, n in leaves if isinstance(n, Q.Phrase)]
        typed = [k for k, n in leaves if isinstance(n, Q.Term) and last_of(n, T.query_tokens(n.text), whole_word)[1] and len(T.query_tokens(n.text)) == 1]
        shown = [k for k, n in leaves if id(n) in good]
        for k, n in leaves:
            if isinstance(n, Q.Own) and n.weight != 1:
                weight = weight * F.when(F.col("leaf") == k, float(n.weight)).otherwise(1.0)
        hits = self._hits(leaves, whole_word)
        df = hits.groupBy("leaf", "field").agg(F.count_if(F.col("tf") > 0).alias("df"))  # a row for each leaf and field
        rows = hits.join(df, ["leaf", "field"]).join(self.fields, "field").join(self.length.select("doc_id", "field", "n"), ["doc_id", "field"])
        score = weight * F.when(F.col("leaf").isin(*double), PHRASE_BOOST).otherwise(1.0) * bm25(F.col("tf"), F.col("n"), F.col("n_docs"), F.col("avg_len"), F.col("df")) + F.when(F.col("leaf").isin(*typed), weight).otherwise(0.0)
        flags = rows.groupBy("doc_id").agg(F.collect_set("leaf").alias("__leaves"), F.sum(F.when(F.col("leaf").isin(*shown), score).otherwise(0.0)).alias("score"))
        found = self.docs.join(flags, "doc_id", "inner" if positive(node) else "left").filter(cond)
        return found.select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def scores(self, query: str, boosts: dict = BOOSTS, whole_word: bool = False) -> DataFrame:
        return self.scored(query, boosts, whole_word)


def last_of(node, words: list[str], whole_word: bool) -> tuple[Column, bool]:
    """What the last word of a leaf asks of a term, and whether longer words count."""
    written = isinstance(node, Q.Term) and node.prefix
    prefix = isinstance(node, Q.Term) and (len(words[-1]) >= LEAST_WRITTEN if written else not whole_word and len(words[-1]) >= LEAST_PREFIX)
    return F.startswith("term", F.lit(words[-1])) if prefix else F.col("term") == words[-1], prefix


def field_stats(length: DataFrame) -> DataFrame:
    return length.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_len"))


def bm25(tf: Column, n: Column, n_docs: Column, avg_len: Column, df: Column) -> Column:
    idf = F.log(F.lit(1) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * n / avg_len))


def positive(node) -> bool:
    """Whether a match must have one of the query's leaves."""
    if isinstance(node, Q.And):
        return any(map(positive, node.parts))
    if isinstance(node, Q.Or):
        return all(map(positive, node.parts))
    return isinstance(node, Q.Own) or isinstance(node, (Q.Term, Q.Phrase)) and bool(T.query_tokens(node.text))


def ranked(index: Index, query: str, limit: int = 10, offset: int = 0, boosts: dict = BOOSTS, whole_word: bool = False) -> DataFrame:
    """The best matches with their scores, ties by doc_id."""
    hits = index.scored(query, boosts, whole_word).withColumn("score", F.round("score", 6))
    return hits.orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)
