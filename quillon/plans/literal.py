"""Candidates of literals, patterns and name queries from an index, and verified pages of them.

The index has three tables over the contents and names of documents. Texts are cut at white space into words, in a form in
which letters that are equal without case are the same:

* ``grams`` (gram, field, n, words): the three-letter parts of the distinct words, sorted by gram within parts by gram. A row
  has the words of one block that the gram is in, with spaces between them;
* ``posts`` (field, word, docs, levels): the documents of each word with their impacts, sorted by word within parts by word
  (long rows lie in any part). An impact is a whole number; a row has the documents of one block, so what is sorted is far less
  than a row for each word of each document;
* ``frequencies`` (gram, n): in how many words a gram is.

Blocks are texts, or words, of a bounded size that one task has met one after another.

A literal without white space lies within one word. The words that have its rarest gram are verified, so what comes out is
the words that have the literal, and from them the documents. A page of matches scores its candidates once, takes them in the
order of their scores, in batches, and reads the texts of those batches only; the many that are left after some batches are
verified where their texts are, and only the page comes back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import query as Q
from .regex import regex_hit, required_literals
from .scan import exact_hit, field_condition, name_condition

GRAM, FIELDS = 3, ("content", "name")
#: Longest word that is a key; longer ones are cut into pieces that overlap by half, so a literal of half their length is whole
#: in one of them.
LONGEST = 128
#: Impacts: weights of the fields, and the levels of a full weight.
WEIGHT, LEVELS = {"content": 1, "name": 2}, 100
K1, B = 1.2, 0.75
#: Candidates of the first batch that is verified, and how batches grow.
BATCH, GROWTH = 256, 4
#: Largest batch whose numbers come to the driver; what follows is verified as a whole on the executors.
LARGEST = 1 << 16
#: Bytes of the texts of a block, and of the words of a block of grams, which has some eight grams for each.
TEXT_BLOCK, WORD_BLOCK = 16 << 20, 4 << 20
#: Words of texts whose posts are sorted by one task; they take some ten bytes each.
RANGE_WORDS = 4_000_000
#: Documents of a row of posts from which on the rows of a word are dealt to all parts.
LONG_ROW = 1_000
#: Most words of a literal that are sent to every executor.
SENT = 1_000_000


def canon(text: Column) -> Column:
    """A form in which texts that are equal without case are equal. (The optimiser would take lower over upper for lower
    alone, so something stands between them.)"""
    dot, none = F.lit("\u0307"), F.lit("")
    upper = F.replace(F.upper(F.replace(text, F.lit("ẞ"), F.lit("ß"))), dot, none)
    return F.replace(F.replace(F.lower(upper), F.lit("ς"), F.lit("σ")), dot, none)


def canon_of(text: str) -> str:
    return text.replace("ẞ", "ß").upper().lower().replace("ς", "σ").replace("̇", "")


def pieces(word: str) -> list[str]:
    """The word, or the overlapping pieces of a long one."""
    return [word[i : i + LONGEST] for i in range(0, max(len(word) - LONGEST // 2, 1), LONGEST // 2)] if len(word) > LONGEST else [word]


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def sizes(texts: pa.Array) -> np.ndarray:
    """How many words each text has, in the form without case or not: of that form, only the lack of dots can take a word away."""
    lists = pc.ascii_split_whitespace(pc.replace_substring(texts, "\u0307", ""))
    full = pc.not_equal(lists.flatten(), "").to_numpy(zero_copy_only=False)
    return np.bincount(pc.list_parent_indices(lists).to_numpy()[full], minlength=len(texts))


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(code, row, tf), by code and row, of the words of texts, the words by code, and how many words each text has."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    row, code, words = pc.list_parent_indices(lists).to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[code]
    row, code = row[full], code[full]
    n = np.bincount(row, minlength=len(texts))
    long = pc.greater(pc.utf8_length(words), LONGEST).to_numpy(zero_copy_only=False)
    if long.any():
        known = words.to_pylist()
        number = {w: k for k, w in enumerate(known)}
        cut = [[number.setdefault(p, len(number)) for p in pieces(w)] if far else [] for w, far in zip(known, long)]
        at = long[code]
        more = [cut[k] for k in code[at]]
        row = np.concatenate([row[~at], np.repeat(row[at], [len(x) for x in more])])
        code = np.concatenate([code[~at], np.fromiter((k for x in more for k in x), np.int64)])
        words = pa.array(list(number), pa.string())
    key, tf = np.unique(code * max(1, len(texts)) + row, return_counts=True)
    return key // max(1, len(texts)), key % max(1, len(texts)), tf, words, n


def repeated(docs: DataFrame) -> bool:
    """Whether several rows have one doc_id."""
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[canon(F.col(f)).alias(f) for f in FIELDS])


def lengths(docs: DataFrame) -> DataFrame:
    """(field, doc_id, n): how many words each field of each row has, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in FIELDS:
                n = pa.array(sizes(batch.column(f)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.repeat(f, len(n)), batch.column("doc_id"), n], names=["field", "doc_id", "n"])

    return docs.select("doc_id", *FIELDS).mapInArrow(run, f"field string, doc_id {_kind(docs)}, n int").filter("n > 0")


def words(docs: DataFrame) -> DataFrame:
    """(field, doc_id, word, tf, n): the words of each field of each document, how often they occur, and words in all. A
    document's words are counted where its text is; only where several rows have one doc_id are their counts put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in FIELDS:
                code, row, tf, known, n = counted(batch.column(f))
                columns = [pa.repeat(f, len(row)), batch.column("doc_id").take(pa.array(row)), known.take(pa.array(code)), pa.array(tf, pa.int64()), pa.array(n[row], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["field", "doc_id", "word", "tf", "n"])

    rows = _texts(docs).mapInArrow(run, f"field string, doc_id {_kind(docs)}, word string, tf bigint, n int")
    if not repeated(docs):
        return rows
    n = lengths(docs).groupBy("field", "doc_id").agg(F.sum("n").cast("int").alias("n"))
    return rows.groupBy("field", "doc_id", "word").agg(F.sum("tf").alias("tf")).join(n, ["field", "doc_id"]).select("field", "doc_id", "word", "tf", "n")


def impact(tf, n, average, weight):
    """The level of a word in a document: its saturated frequency, from 0 to LEVELS times the field's weight, of which the
    whole part counts. For Columns and for arrays."""
    return LEVELS * weight * tf / (tf + K1 * ((1 - B) + B * n / average))


def impacts(docs: DataFrame, average: dict[str, float]) -> DataFrame:
    """(field, word, docs, levels) of documents without repeated numbers: a row for each word of a block of texts."""
    block = TEXT_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, block):
            for f in FIELDS:
                code, row, tf, known, n = counted(batch.column(f))
                if not len(row):
                    continue
                level = pa.array(np.floor(impact(tf, n[row], average[f], WEIGHT[f])), pa.int16())
                first = np.flatnonzero(np.diff(code, prepend=-1))
                at = pa.array(np.append(first, len(code)), pa.int32())
                columns = [pa.repeat(f, len(first)), known.take(pa.array(code[first])), pa.ListArray.from_arrays(at, batch.column("doc_id").take(pa.array(row))), pa.ListArray.from_arrays(at, level)]
                yield pa.RecordBatch.from_arrays(columns, names=["field", "word", "docs", "levels"])

    return _texts(docs).mapInArrow(run, f"field string, word string, docs array<{_kind(docs)}>, levels array<smallint>")


def grams(distinct: DataFrame) -> DataFrame:
    """(gram, field, n, words) of distinct (field, word): a row for each gram of a block of words."""
    block = WORD_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, block):
            for f in FIELDS:
                known = batch.filter(pc.equal(batch.column("field"), f)).column("word")
                gram, first, of = grams_of(known)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), known.take(pa.array(of))), " ")
                columns = [pa.array(gram, pa.string()), pa.repeat(f, len(gram)), pa.array(np.diff(first), pa.int32()), joined]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "field", "n", "words"])

    return distinct.select("field", "word").mapInArrow(run, "gram string, field string, n int, words string")


def grams_of(known: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The grams of words, each once, and for each its words: places in the third array from one offset to the next."""
    size = pc.utf8_length(known).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.frombuffer("".join(known.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    of, end = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size), size)
    at = np.flatnonzero(np.arange(len(letters)) + GRAM <= end)
    key, of = reduce(lambda k, i: k << 21 | letters[at + i], range(GRAM), np.zeros(len(at), np.int64)), of[at]
    order = np.argsort(key, kind="stable")
    key, of = key[order], of[order]
    once = (np.diff(key, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0)  # a gram that a word has twice
    key, of = key[once], of[once]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    gram = ["".join(chr(k >> 21 * i & 0x1FFFFF) for i in reversed(range(GRAM))) for k in key[first].tolist()]
    return gram, np.append(first, len(key)), of


def write(docs: DataFrame, where: str, partitions: int | None = None) -> None:
    """Writes the index of ``docs`` (doc_id, content, name) under ``where``. Null texts have no words."""
    spark = docs.sparkSession
    many, n = repeated(docs), lengths(docs)
    if many:
        n = n.groupBy("field", "doc_id").agg(F.sum("n").alias("n"))
    n.groupBy("field").agg(F.avg("n").alias("average"), F.sum("n").alias("total")).write.mode("overwrite").parquet(f"{where}/fields")
    fields = spark.read.parquet(f"{where}/fields")
    known = fields.collect()  # a row for each field
    if many:
        weight = F.when(F.col("field") == "name", WEIGHT["name"]).otherwise(WEIGHT["content"])
        level = F.floor(impact(F.col("tf"), F.col("n"), F.col("average"), weight)).cast("smallint")
        found = words(docs).join(fields, "field").select("field", "word", F.array("doc_id").alias("docs"), F.array(level).alias("levels"))
    else:
        found = impacts(docs, {r["field"]: r["average"] for r in known})
    count = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["total"] for r in known) // RANGE_WORDS))
    # dealt by hash, since ranges would have all that stands before them done twice, once for a sample
    apart = F.when(F.size("docs") >= LONG_ROW, F.col("docs")[0])
    found.repartition(count, "word", apart).sortWithinPartitions("word", "field").write.mode("overwrite").parquet(f"{where}/posts")
    distinct = spark.read.parquet(f"{where}/posts").select("field", "word").distinct()
    grams(distinct).repartition(count, "gram").sortWithinPartitions("gram", "field").write.mode("overwrite").parquet(f"{where}/grams")
    spark.read.parquet(f"{where}/grams").groupBy("gram").agg(F.sum("n").alias("n")).sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{where}/frequencies")


class LiteralIndex:
    """The written tables, beside the documents that they are of."""

    def __init__(self, docs: DataFrame, where: str):
        read = docs.sparkSession.read
        self.docs, self.spark = docs, docs.sparkSession
        self.posts, self.grams, self.frequencies = (read.parquet(f"{where}/{t}") for t in ("posts", "grams", "frequencies"))
        self.verified = 0  # documents whose text the last page read

    def words_with(self, literal: str, fields: tuple = FIELDS) -> DataFrame:
        """(field, word) of the words that have a literal of three characters or more, without white space, in either case."""
        return self._words_with(literal, fields)[0]

    def _words_with(self, literal: str, fields: tuple) -> tuple[DataFrame, int]:
        """The same, and how many they are at most."""
        want = canon_of(literal)[: LONGEST // 2]
        grams = {want[i : i + GRAM] for i in range(len(want) - GRAM + 1)}
        known = self.frequencies.filter(F.col("gram").isin(*grams)).orderBy("n", "gram").collect()  # one row for each gram of the literal
        rarest = known[0]["gram"] if len(known) == len(grams) else None  # a gram that no word has: nor is the literal in one
        rows = self.grams.filter((F.col("gram") == rarest if rarest is not None else F.lit(False)) & F.col("field").isin(*fields))
        rows = rows.select("field", F.explode(F.split("words", " ")).alias("word")).filter(F.contains("word", F.lit(want)))
        return rows.distinct(), known[0]["n"] if rarest is not None else 0

    def postings(self, literals: list[str], fields: tuple = FIELDS) -> DataFrame | None:
        """(part, field, level, doc_id) of the documents that have each literal; None if none of them is long enough. The table
        is read once for all of them."""
        usable = list(dict.fromkeys(x for x in literals if len(canon_of(x)) >= GRAM))
        if not usable:
            return None
        found = [self._words_with(x, fields) for x in usable]
        wanted = reduce(DataFrame.unionByName, [rows.select(F.lit(k).alias("part"), "field", "word") for k, (rows, _) in enumerate(found)])
        if sum(n for _, n in found) <= SENT:
            wanted = F.broadcast(wanted)
        return self.posts.join(wanted, ["field", "word"]).select("part", "field", F.explode(F.arrays_zip("levels", "docs")).alias("x")).select("part", "field", F.col("x.levels").cast("int").alias("level"), F.col("x.docs").alias("doc_id"))

    def candidates(self, literals: list[str], fields: tuple = FIELDS) -> DataFrame:
        """(doc_id) of documents that may have all the literals within one of the fields: no document that has them is left out."""
        posts = self.postings(literals, fields)
        if posts is None:
            return self.docs.select("doc_id")
        parts = len({x for x in literals if len(canon_of(x)) >= GRAM})
        return posts.groupBy("doc_id", "field").agg(F.count_distinct("part").alias("parts")).filter(F.col("parts") == parts).select("doc_id").distinct()

    def matching(self, hit: Column, literals: list[str], conditions: list[Column] = (), fields: tuple = FIELDS) -> DataFrame:
        """The documents that ``hit`` verifies, read for the candidates alone."""
        rows = reduce(DataFrame.filter, conditions, self.docs)
        return rows.join(self.candidates(literals, fields), "doc_id", "left_semi").filter(hit)

    def page(self, hit: Column, literals: list[str], conditions: list[Column] = (), limit: int = 10, offset: int = 0, sort: str = "relevance", batch: int = BATCH) -> tuple[DataFrame, bool]:
        """The page of (doc_id, score) of verified documents, best first, ties by doc_id, and whether more follow.

        Candidates come in the order of the result, in growing batches; the texts of a batch are read and verified on the
        executors, and only numbers come back. It stops when one document more than asked for is sure. Where a batch would be
        larger than LARGEST, all candidates that are left are verified at once and the first ones of them come back. ``sort``:
        relevance, modified, size or name.
        """
        need, self.verified = offset + limit + 1, 0
        sure: list[tuple] = []
        given: list[int] = []
        rows, order = self._ordered(literals, conditions, sort)
        rows = rows.persist()
        try:
            while len(sure) < need:
                if batch > LARGEST:
                    left = rows.join(F.broadcast(self._numbers(given)), "doc_id", "left_anti")
                    good = self.docs.filter(hit).select("doc_id")
                    found = left.join(good, "doc_id", "left_semi").orderBy(*order).limit(need - len(sure)).collect()
                    sure += [(r["doc_id"], float(r["score"])) for r in found]
                    self.verified = rows.count()
                    break
                part = rows.orderBy(*order).offset(len(given)).limit(batch).select("doc_id", "score").collect()  # a batch of numbers
                given += [r["doc_id"] for r in part]
                self.verified = len(given)
                if part:
                    ids = F.broadcast(self._numbers(given[-len(part) :]))
                    good = {r["doc_id"] for r in self.docs.join(ids, "doc_id").filter(hit).select("doc_id").collect()}
                    sure += [(r["doc_id"], float(r["score"])) for r in part if r["doc_id"] in good]
                if len(part) < batch:
                    break
                batch *= GROWTH
        finally:
            rows.unpersist()
        return self.spark.createDataFrame(sure[offset : offset + limit], "doc_id long, score double"), len(sure) >= need

    def _numbers(self, ids: list[int]) -> DataFrame:
        return self.spark.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64())}))

    def _ordered(self, literals: list[str], conditions: list[Column], sort: str) -> tuple[DataFrame, list]:
        """The candidates (doc_id, score) with what they are ordered by, and that order. A document's score is the sum of its
        best impacts for each literal."""
        posts = self.postings(literals) if sort == "relevance" else None
        narrow = reduce(DataFrame.filter, conditions, self.docs)
        if posts is not None:
            parts = len({x for x in literals if len(canon_of(x)) >= GRAM})
            best = [F.max(F.when(F.col("part") == k, F.col("level"))) for k in range(parts)]
            rows = posts.groupBy("doc_id").agg(reduce(lambda a, b: a + b, best).alias("score")).filter(F.col("score").isNotNull())  # null where a part is missing
            return rows.join(narrow.select("doc_id"), "doc_id", "left_semi") if conditions else rows, [F.desc("score"), F.col("doc_id")]
        by = {"modified": ["mtime"], "size": ["size"], "name": ["name_lc"]}.get(sort, [])
        if any(len(canon_of(x)) >= GRAM for x in literals):
            narrow = narrow.join(self.candidates(literals), "doc_id", "left_semi")
        return narrow.select("doc_id", *by, F.lit(0.0).alias("score")), [*[F.col(c) if c == "name_lc" else F.desc(c) for c in by], F.col("doc_id")]


def parts_of(literal: str) -> list[str]:
    return literal.split()


def exact(index: LiteralIndex, literal: str, case_sensitive: bool = False, whole_word: bool = False) -> DataFrame:
    """The documents that ``scan.exact`` finds."""
    fields, rest = Q.split_filters(literal)
    conditions = [field_condition(f) for f in fields]
    return index.matching(exact_hit(rest, case_sensitive, whole_word), parts_of(rest), conditions)


def exact_page(index: LiteralIndex, literal: str, case_sensitive: bool = False, whole_word: bool = False, **page) -> tuple[DataFrame, bool]:
    fields, rest = Q.split_filters(literal)
    return index.page(exact_hit(rest, case_sensitive, whole_word), parts_of(rest), [field_condition(f) for f in fields], **page)


def regex(index: LiteralIndex, pattern: str, case_sensitive: bool = False, whole_word: bool = False) -> DataFrame:
    """The documents that ``regex.regex_scan`` finds."""
    fields, rest = Q.split_filters(pattern)
    return index.matching(regex_hit(rest, case_sensitive, whole_word), required_literals(rest), [field_condition(f) for f in fields])


def regex_page(index: LiteralIndex, pattern: str, case_sensitive: bool = False, whole_word: bool = False, **page) -> tuple[DataFrame, bool]:
    fields, rest = Q.split_filters(pattern)
    return index.page(regex_hit(rest, case_sensitive, whole_word), required_literals(rest), [field_condition(f) for f in fields], **page)


def fixed_parts(glob: str) -> list[str]:
    """The runs of a name query's word that every name has: what stands between its wildcards."""
    return [p for p in glob.replace("?", "*").split("*") if p]


def filename(index: LiteralIndex, query: str, score: Callable | None = None) -> DataFrame:
    """The documents that ``scan.filename`` finds, with a score: how many of the query's words stand in the name as whole
    words. Names are read for candidates alone where a word of the query has a fixed part of three characters."""
    from .scan import name_score

    fields, rest = Q.split_filters(query)
    given = rest.split()
    conditions = [*map(field_condition, fields), *map(name_condition, given)]
    literals = [p for w in given for p in fixed_parts(w)]
    rows = reduce(DataFrame.filter, conditions, index.docs)
    if any(len(canon_of(p)) >= GRAM for p in literals):
        rows = rows.join(index.candidates(literals, ("name",)), "doc_id", "left_semi")
    return rows.withColumn("score", (score or name_score)(given))
