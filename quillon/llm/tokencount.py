"""Token counts, with overlap resynchronisation for huge documents.

A text longer than a chunk is encoded by the library in overlapping chunks, with the offsets of the tokens. In the overlap
two neighbours are spliced at the start of a word after ASCII white space where both begin a token and from which both have
the same tokens up to the next such start. Such a place is stable: no token spans ASCII white space and nothing before it
has an influence on what follows, so the left chunk is right up to it and the right chunk from it on. Where the overlap has
no such place it is doubled; where it reaches back over the whole chunk, the chunk itself grows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .base import map_texts, table
from .wordtable import Library, word_ids

#: Characters of a chunk and of the first overlap that is tried.
CHUNK, OVERLAP = 32_768, 256
_STARTS = re.compile("(?<=[ \t-\r])[^ \t-\r]")


def meet(text: str, lo: int, to: int, left: tuple, right: tuple) -> int | None:
    """The first stable place in (lo, to) at which the left chunk's tokens and the right's agree; None if there is none.

    left, right: ids and where their tokens begin, counted in the whole text."""
    places = np.array([m.start() for m in _STARTS.finditer(text, lo, to)], np.int64)
    places = places[(places > lo) & np.isin(places, left[1]) & np.isin(places, right[1])]
    for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
        both = [ids[np.searchsorted(at, a) : np.searchsorted(at, b)] for ids, at in (left, right)]
        if both[0] == both[1]:
            return a
    return None


def count_spliced(library: Library, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of ``text``, from overlapping chunks."""

    def encoded(a: int, b: int) -> tuple:
        ids, at = library.starts(text[a:b])
        return ids, at + a

    total = begin = at = 0  # tokens before ``begin`` are counted; the left chunk is text[at:to]
    to = min(len(text), chunk)
    left = encoded(at, to)
    while to < len(text):
        wide, place = overlap, None
        while place is None and to - wide > at:
            hi = min(len(text), to + max(chunk - overlap, 1))
            lo = max(to - wide, begin)
            right = encoded(lo, hi)
            place = meet(text, lo, to, left, right)
            wide *= 2
        if place is None:  # nothing in the whole chunk is stable
            to = min(len(text), 2 * to - at)
            left = encoded(at, to)
            continue
        total += int(np.searchsorted(left[1], place) - np.searchsorted(left[1], begin))
        begin, at, to, left = place, lo, hi, right
    return total + len(left[0]) - int(np.searchsorted(left[1], begin))


class Counter:
    """n_bytes, n_tokens and over_limit of texts. Short texts are counted by their words, which the library has encoded."""

    def __init__(self, path: str, limit: int, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.path, self.limit, self.chunk, self.overlap = path, limit, chunk, overlap

    def __call__(self, texts: list) -> dict:
        words, n = word_ids(self.path), np.zeros(len(texts), np.int64)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        n[short] = [len(x) // words.width for x in words.packed([texts[i] for i in short])]
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                n[i] = count_spliced(words.library, t.decode("utf-8", "replace"), self.chunk, self.overlap)
        return {"n_bytes": np.fromiter(map(len, texts), np.int64, len(texts)), "n_tokens": n, "over_limit": n > self.limit}


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``keep``, n_bytes, n_tokens, over_limit. Null and empty texts have 0 tokens; very long
    texts are spliced from chunks; rows with equal ids are counted each; an empty table gives no rows; columns outside
    ``keep`` are not read, and a name of ``keep`` that the result uses itself is an error. ``path``: a tokenizers file whose
    tokens never span ASCII white space."""
    return map_texts(docs, Counter(path, limit), "n_bytes bigint, n_tokens bigint, over_limit boolean", id_col, text_col, keep)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
