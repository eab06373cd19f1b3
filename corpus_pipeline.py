"""The training-data pipeline: quality filter, near-duplicates, repeated passages, benchmark leaks, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, leaks, quality, simhash, suffix
from quillon.llm.base import held_fold, release, shared_dir, stored, table, unused

#: Bytes of a row group between stages, so that few long texts are read at once; parts of texts that the last stage's
#: workers remember beside what the stages before have left in them. Neither changes a result.
ROW_GROUP, REMEMBERED = 8 << 20, 250_000


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts. It learns from the labels of these documents.

    All columns stay as they are, whatever their names; null texts are scored as empty ones, long ones whole, repeated rows
    alike; without labels of both kinds each document has the same score; an empty table gives none.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_fold("doc_id", 4, 2))
    return quality.accepted(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    All columns stay as they are. Texts without words are near-duplicates of each other; null ids stay; rows of one id and
    text stay or go together; an empty table gives none.
    """
    return simhash.distinct_documents(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id has; n_chars is that of what is left.

    Other columns stay as they are, whatever their names: they travel in one column. A text that is null or wholly a repeat
    becomes empty; rows of one id do not cut each other; null ids are cut by all; an empty table gives none.
    """
    rest, box = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")], unused("rest", docs.columns)
    boxed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)]).alias(box))
    cut = suffix.deduplicated(boxed, keep=(box,))
    made = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text"), **{c: F.col(f"{box}.c{k}") for k, c in enumerate(rest)}}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[made[c].alias(c) for c in docs.columns])


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have no benchmark item in them.

    All columns stay as they are, whatever their names; null and empty texts stay, long ones are searched whole, repeated
    rows go together; without items all stay.
    """
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, digests of the ids and of what they decode to, and the ids.

    Null and empty texts have no ids, long ones are encoded whole, repeated rows get a row each; other columns are not read.
    """
    return bpe.bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True, keep=("lang", "source"), most=REMEMBERED)


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_leaks),
    ("byte-level bpe", token_ids),
]

#: SQL can express neither the classifier nor the suffix arrays over whole tables; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each one's rows are written as Parquet and read again for the next."""
    docs, where = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"{where}/stage-{k}", ROW_GROUP)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
