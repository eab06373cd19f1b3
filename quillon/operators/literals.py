"""A batch of literals against all texts: one pass with an automaton for each block of literals of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 8_000_000


def plain(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def literal_matches(docs: DataFrame, literals: DataFrame, id_col: str = "doc_id", text_col: str = "content", key: str = "item_id", literal: str = "text") -> DataFrame:
    """(key, id) of every text that has a literal in it, runs of white space counting as one space, upper and lower case
    apart. Null and blank literals match nothing."""
    out, block, size = None, [], 0
    for r in literals.select(key, literal).filter(F.trim(literal) != "").toLocalIterator():
        block.append((r[0], plain(r[1])))
        size += len(r[1])
        if size >= BLOCK_CHARS:
            out, block, size = _union(out, _pass(docs, block, id_col, text_col, key)), [], 0
    return _union(out, _pass(docs, block, id_col, text_col, key))


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _pass(docs: DataFrame, block: list, id_col: str, text_col: str, key: str) -> DataFrame:
    src = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        tree, by = ahocorasick.Automaton(), {}
        for k, text in block:
            by.setdefault(text, []).append(k)
        for text in by:
            tree.add_word(text, text)
        if by:
            tree.make_automaton()
        for batch in batches:
            keys, ids = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for text in {x for _, x in tree.iter(plain(t))} if t and by else ():
                    keys += by[text]
                    ids += [i] * len(by[text])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], names=[key, id_col])

    return src.mapInArrow(run, f"{key} bigint, {id_col} bigint")
