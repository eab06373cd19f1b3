"""Language identification by prediction by partial matching.

For each language the training texts give a tree of byte contexts: how often each byte followed each context of up to
``DEPTH`` bytes. A byte is priced by the longest context of the text in which it was seen; each longer context that was met
without it adds the price of an escape (method C, without exclusions: a context met n times with d different bytes gives
count / (n + d) to a byte and d / (n + d) to the escape; after the empty context each byte has 1/256). The statistics are frozen: they do not change while a text is priced, so a price depends on a
byte and its context alone and a text's code length is an exact sum. The language with the shortest code wins.

All training texts are counted, on executors; the counts are written to the shared folder and read from there by the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import held_fold, map_texts, shared_dir, slices, stored, table, trim, unused
from .files import place

#: Bytes of the longest context, and what stands before each text, in training and scoring alike.
DEPTH = 4
START = b"\n" * DEPTH
#: Grams (a context and its byte) that a language's model keeps, the most frequent first; languages that are priced at once;
#: bytes that are priced at once; grams that a counting task gathers before it hands them on.
GRAMS, GROUP, STEP, GATHER = 1 << 17, 16, 1 << 20, 1 << 20


def codes(data: bytes) -> np.ndarray:
    """For each byte after the first ``DEPTH``, the number that it and the ``DEPTH`` bytes before it make."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(x) - DEPTH
    out = np.zeros(n, np.uint64)
    for k in range(DEPTH + 1):
        out = (out << np.uint64(8)) | x[k : k + n]
    return out


def joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all bytes of the texts, and where each text's begin; texts do not see each other."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.r_[0, np.cumsum(lengths)]
    whole = codes(b"".join(y for x in texts for y in (START, x)) or START)
    own = np.ones(len(whole), bool)  # a code that ends in the start marks of a later text is nobody's
    at = starts[1:-1] + DEPTH * np.arange(len(texts) - 1)
    for k in range(DEPTH):
        own[at + k] = False
    return whole[own], starts


def pieces(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, owner of each code) of the texts, about ``STEP`` bytes at a time; long texts go on in the next piece."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= STEP):
            total += len(texts[end])
            end += 1
        if total <= STEP:
            c, starts = joined(texts[at:end])
            yield c, np.repeat(np.arange(at, end), np.diff(starts))
        else:  # one long text
            for lo in range(0, total, STEP):
                part = texts[at][max(0, lo - DEPTH) : lo + STEP]
                c = codes(part if lo else START + part)
                yield c, np.full(len(c), at)
        at = end


def counted(docs: DataFrame, lang: str, text_col: str) -> DataFrame:
    """(lang, code, n): how often each gram occurs in the texts of each language."""
    src = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                code, n = merged(parts)
                for lo in range(0, len(code), 65_536):
                    c, k = code[lo : lo + 65_536], n[lo : lo + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(c)), pa.array(c.astype(np.int64)), pa.array(k)], names=["lang", "code", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                texts, names = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
                for name in sorted(set(names)):
                    for c, _ in pieces([t for t, y in zip(texts, names) if y == name]):
                        held[name] = [merged([*held.get(name, []), np.unique(c, return_counts=True)])]
                size = sum(len(x[0][0]) for x in held.values())
                if size > GATHER:
                    yield from out()
                    held.clear()
        yield from out()
        trim()

    return src.mapInArrow(run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams and counts of several such pairs."""
    if len(parts) == 1:
        return parts[0]
    code, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(first) else n


class Tree:
    """The context tree of one language: for each depth the grams with their prices and the contexts with their escapes."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.total = int(n.sum())
        self.levels = []
        for depth in range(DEPTH, -1, -1):
            gram, count = merged([(code & np.uint64((1 << 8 * (depth + 1)) - 1), n), (np.zeros(0, np.uint64), np.zeros(0, np.int64))])
            context = gram >> np.uint64(8)
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
            seen, kinds = (np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in (count.astype(np.float64), np.ones(len(gram))))
            of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(gram)]))
            price = -np.log2(count / (seen + kinds)[of]) if len(gram) else np.zeros(0)
            self.levels.append((gram, price, context[first], -np.log2(kinds / (seen + kinds))))

    def prices(self, code: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte after its context."""
        bits, open_ = np.zeros(len(code)), np.arange(len(code))
        for depth, (gram, price, context, escape) in zip(range(DEPTH, -1, -1), self.levels):
            c = code[open_] & np.uint64((1 << 8 * (depth + 1)) - 1)
            at, hit = find(gram, c)
            bits[open_[hit]] += price[at[hit]]
            open_, c = open_[~hit], c[~hit]
            at, met = find(context, c >> np.uint64(8))
            bits[open_[met]] += escape[at[met]]
        bits[open_] += 8.0
        return bits


def find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return at, known[at] == asked


def read_trees(where: str, group: int) -> tuple[list[str], list[Tree]]:
    """The languages of a group, in the order of their names, and their trees."""
    system, path = place(f"{where}/part={group}")
    from pyarrow import fs

    files = sorted(x.path for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.path.endswith(".parquet"))
    parts = [pq.read_table(system.open_input_file(f), schema=pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])) for f in files]
    if not parts:
        return [], []
    whole = pa.concat_tables(parts)
    lang, code, n = np.array(whole.column("lang").to_pylist(), object), whole.column("code").to_numpy().astype(np.uint64), whole.column("n").to_numpy()
    names = sorted(set(lang))
    trees = []
    for name in names:
        mine = lang == name
        order = np.argsort(code[mine])
        trees.append(Tree(code[mine][order], n[mine][order]))
    return names, trees


kept_trees = lru_cache(2)(read_trees)


class Model:
    """Where the grams of ``groups`` groups of languages lie; an empty model knows no language."""

    def __init__(self, where: str, groups: int):
        self.where, self.groups = where, groups

    def trees(self) -> Iterator[tuple[list[str], list[Tree]]]:
        for g in range(self.groups):
            yield (kept_trees if self.groups <= 2 else read_trees)(self.where, g)

    def __call__(self, texts: list) -> dict:
        """lang_pred, score and bits_per_byte of texts. The score is the probability of the language among all, by code
        lengths and the languages' shares of the training bytes."""
        names: list[str] = []
        weights: list[float] = []
        bits: list[np.ndarray] = []
        for some, trees in self.trees():
            found = np.zeros((len(trees), len(texts)))
            for c, owner in pieces(texts):
                grams, back = np.unique(c, return_inverse=True)
                for k, tree in enumerate(trees):
                    found[k] += np.bincount(owner, tree.prices(grams)[back], len(texts))
            names += some
            weights += [t.total for t in trees]
            bits += list(found)
        if not names:
            return {"lang_pred": pa.nulls(len(texts), pa.string()), "score": np.zeros(len(texts)), "bits_per_byte": np.full(len(texts), 8.0)}
        cost = np.array(bits) - np.log2(np.array(weights) / sum(weights))[:, None]
        order = np.argsort(names)  # ties go to the first name
        cost, least = cost[order], cost.min(0)
        chosen = order[cost.argmin(0)]
        score = 1 / np.exp2(-np.minimum(cost - least, 1000)).sum(0)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        rate = np.array(bits)[chosen, np.arange(len(texts))] / np.maximum(sizes, 1)
        return {"lang_pred": pa.array([names[i] for i in chosen], pa.string()), "score": score, "bits_per_byte": rate}


def most_frequent(counts: DataFrame, grams: int) -> DataFrame:
    """Of (lang, code, n) the ``grams`` first of each language, the most frequent first, then by code.

    Grams of one count and first byte make a cell. Only cells are brought in order over a language; of the cell in which a
    language's share ends, and in no other, single grams are ranked.
    """
    cell = ["lang", "n", "high"]
    rows = counts.withColumn("high", F.shiftright("code", 8 * DEPTH))
    upto = F.sum("size").over(Window.partitionBy("lang").orderBy(F.desc("n"), "high").rowsBetween(Window.unboundedPreceding, 0))
    cells = rows.groupBy(*cell).agg(F.count("*").alias("size")).withColumn("left", F.lit(grams) - upto + F.col("size")).filter("left > 0")
    kept = rows.join(cells, cell)
    last = kept.filter("left < size").withColumn("place", F.row_number().over(Window.partitionBy(*cell).orderBy("code"))).filter("place <= left")
    return kept.filter("left >= size").select("lang", "code", "n").unionByName(last.select("lang", "code", "n"))


def fit(docs: DataFrame, train: Column, lang_col: str = "lang", text_col: str = "text", grams: int = GRAMS, group: int = GROUP) -> Model:
    """A model of each language of the rows for which ``train`` holds and lang is not null.

    All such rows are counted, whole. A language's model keeps its ``grams`` most frequent grams (ties by the bytes), so its
    size is bounded whatever the data; its contexts' counts are those of what is kept. Null texts teach nothing; a language
    whose texts are all empty is not learned.
    """
    where = f"{shared_dir(docs.sparkSession)}/grams"
    most = most_frequent(stored(counted(docs.filter(train), lang_col, text_col), f"{where}-counted"), grams)
    most = stored(most, f"{where}-all")
    groups = -(-most.agg(F.count_distinct("lang")).first()[0] // group)
    most.withColumn("part", F.pmod(F.xxhash64("lang"), F.lit(max(1, groups)))).repartition("part").write.partitionBy("part").parquet(where)
    return Model(where, groups)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep``, lang_pred, score (0 to 1) and bits_per_byte.

    A null text, a text without a letter, and any text if no language was learned, is ``und`` with score 0. Only the text
    enters the prediction; long texts are priced whole; equal code lengths go to the language first by name; repeated rows
    get repeated results, an empty table none. A name of ``keep`` that the result uses itself is an error.
    """
    flag = unused("letters", [id_col, text_col, *keep, "lang_pred", "score", "bits_per_byte"])
    asked = docs.select(*{c: F.col(f"`{c}`") for c in (id_col, *keep, text_col)}.values(), F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)).alias(flag))
    told = map_texts(asked, model, "lang_pred string, score double, bits_per_byte double", id_col, text_col, (*keep, flag))
    known = F.col(flag) & F.col("lang_pred").isNotNull()
    return told.withColumn("score", F.when(known, F.col("score")).otherwise(0.0)).withColumn("lang_pred", F.when(known, F.col("lang_pred")).otherwise("und")).drop(flag)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_fold("doc_id", 3, 1)
    return predict(docs, fit(docs, ~held)).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
