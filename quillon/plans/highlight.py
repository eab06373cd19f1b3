"""Snippets and previews of pages, in all modes, on the executors: texts never come to the driver.

A highlighter gives the (from, to) of the matches in each text of a batch. There are three: of words and phrases, of
patterns (exact literals among them), and one that finds nothing, for names. Others may be given in their place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as ST

from ..functions import excerpt as X
from ..functions import query as Q
from .regex import compiled

#: Characters of private use, from which two that no text of a batch has become the marks of a match. Fixed values.
PRIVATE = range(0xE000, 0xF900)


class Highlighter(Protocol):
    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]: ...


class Words:
    """Matches of the words and phrases of a query that are not under NOT."""

    def __init__(self, query: str, case_sensitive: bool = False, whole_word: bool = False):
        self.leaves, self.options = Q.leaves(Q.parse(query)), (case_sensitive, whole_word)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        return [X.highlights(t, self.leaves, *self.options) for t in texts]


class Pattern:
    """Matches of an expression, found in linear time: it is replaced by itself between two marks. Empty matches show nothing.

    ``edges``: a match counts only where it has no letter, digit or underscore before it, or behind it."""

    def __init__(self, expression: str, edges: tuple[bool, bool] = (False, False)):
        flags, body = re.fullmatch(r"(\(\?\w+\))?(.*)", expression, re.S).groups()
        self.expression, self.edges = f"{flags or ''}({body})", edges

    @classmethod
    def regex(cls, pattern: str, case_sensitive: bool = False, whole_word: bool = False) -> Pattern:
        return cls(compiled(pattern, case_sensitive), (whole_word, whole_word))

    @classmethod
    def literal(cls, literal: str, case_sensitive: bool = False, whole_word: bool = False) -> Pattern:
        parts = literal.split()
        body = r"[\t-\r ]+".join(re.sub(r"([\\.^$|()\[\]{}+*?\-])", r"\\\1", p) for p in parts)
        return cls(body if case_sensitive else f"(?i){body}", (whole_word and parts[0][0].isalnum(), whole_word and parts[-1][-1].isalnum()))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        used = set().union(*map(set, texts))
        left, right = [c for c in map(chr, PRIVATE) if c not in used][:2]
        marked = pc.replace_substring_regex(pa.array(texts, pa.string()), self.expression, rf"{left}\1{right}").to_pylist()
        return [self._kept(t, [(a - 2 * k, b - 2 * k - 1) for k, (a, b) in enumerate(self._marks(m, left, right))]) for t, m in zip(texts, marked)]

    @staticmethod
    def _marks(text: str, left: str, right: str) -> Iterator[tuple[int, int]]:
        at = text.find(left)
        while at >= 0:
            end = text.find(right, at)
            yield at, end
            at = text.find(left, end)

    def _kept(self, text: str, spans: list) -> list[tuple[int, int]]:
        inner = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
        return [(a, b) for a, b in spans if a < b and not (self.edges[0] and inner(a - 1)) and not (self.edges[1] and inner(b))]


class Nothing:
    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        return [[] for _ in texts]


def highlighter(mode: str, query: str, case_sensitive: bool = False, whole_word: bool = False) -> Highlighter:
    rest = Q.split_filters(query)[1] if mode in ("exact", "regex") else query
    if mode == "smart":
        return Words(query, case_sensitive, whole_word)
    if mode == "filename" or not rest.strip():
        return Nothing()
    return (Pattern.literal if mode == "exact" else Pattern.regex)(rest, case_sensitive, whole_word)


PREVIEW_TYPE = "struct<sections:array<struct<text:string,highlights:array<struct<start:int,end:int>>,location:string,first_match:int>>,total:int,capped:boolean>"
SPANS_TYPE = "array<struct<start:int,end:int>>"


def shown(df: DataFrame, marks: Highlighter, what: str = "snippets", text_col: str = "content", keys: tuple = ("path",), heads: bool = True) -> DataFrame:
    """``keys`` and a column ``what`` (snippets, preview or spans) for each row of ``df``; a column ``anchors`` gives the places,
    if there is one. Null texts are empty. A snippet of a text without a match is its head, with ``heads``."""
    names = [*keys, text_col, *(["anchors"] if "anchors" in df.columns else [])]
    src = df.select(*names)
    kind = {"snippets": X.SNIPPET_TYPE, "preview": PREVIEW_TYPE, "spans": SPANS_TYPE}[what]
    schema = ST.StructType([*(src.schema[c] for c in keys), ST.StructField(what, ST._parse_datatype_string(kind))])
    arrow = arrow_type(schema[what].dataType)

    def one(text: str, spans: list, places: list):
        if what == "spans":
            return [{"start": a, "end": b} for a, b in spans]
        if what == "preview":
            return X.preview_of_spans(text, spans, places)
        return X.with_head(text, X.of_spans(text, spans, places)) if heads else X.of_spans(text, spans, places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            told = batch.column("anchors").to_pylist() if "anchors" in names else [None] * len(texts)
            places = [[X.Anchor(x["offset"], x["kind"], x["num"], x["label"]) for x in a or []] for a in told]
            found = list(map(one, texts, marks.spans(texts) if texts else [], places))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(found, arrow)], names=[*keys, what])

    return src.mapInArrow(run, schema)


def arrow_type(kind: ST.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
