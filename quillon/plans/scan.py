"""Queries as Columns over a document relation: the specification that the index must agree with."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as T

FIELDS = ("content", "name", "meta")
LEAST_PREFIX, LEAST_WRITTEN = 3, 2


def analysed(df: DataFrame, fields: tuple = FIELDS, case_sensitive: bool = False, arabic: bool = False) -> DataFrame:
    """Adds __<field>, the field's tokens between single spaces, and for Arabic queries __bare_<field>, without articles."""
    for f in fields:
        toks = T.words(F.col(f)) if case_sensitive else T.tokens(F.col(f))
        df = df.withColumn(f"__{f}", T.joined(toks))
        if arabic and not case_sensitive:
            df = df.withColumn(f"__bare_{f}", T.joined(F.transform(toks, T.bare)))
    return df


def leaf_pattern(node, whole_word: bool = False, case_sensitive: bool = False) -> str | None:
    """What a leaf looks for in joined tokens; None if it has no tokens. Without a space at its end it is a prefix."""
    words = [node.text[a:b] for a, b in T.spans(node.text)] if case_sensitive else T.query_tokens(node.text)
    if not words:
        return None
    if isinstance(node, Q.Phrase):
        prefix = False
    elif node.prefix:
        prefix = len(words[-1]) >= LEAST_WRITTEN
    else:
        prefix = not whole_word and len(words[-1]) >= LEAST_PREFIX
    return f" {' '.join(words)}" + ("" if prefix else " ")


def condition(node, whole_word: bool = False, case_sensitive: bool = False, fields: tuple = FIELDS) -> Column | None:
    """The Column of a tree. Leaves without tokens set no condition."""
    if node is None:
        return None
    if isinstance(node, (Q.And, Q.Or)):
        parts = [c for c in (condition(p, whole_word, case_sensitive, fields) for p in node.parts) if c is not None]
        return reduce(and_ if isinstance(node, Q.And) else or_, parts) if parts else None
    if isinstance(node, Q.Not):
        inner = condition(node.part, whole_word, case_sensitive, fields)
        return None if inner is None else ~inner
    if isinstance(node, Q.Field):
        return field_condition(node)
    if isinstance(node, Q.Own):
        return node.condition(fields)
    pattern = leaf_pattern(node, whole_word, case_sensitive)
    if pattern is None:
        return None
    both = ("__", "__bare_") if T.is_arabic(node.text) and not case_sensitive else ("__",)
    return reduce(or_, [F.contains(F.col(f"{kind}{f}"), F.lit(pattern)) for f in fields for kind in both])


def name_condition(pattern: str) -> Column:
    """A glob over the whole name where it has * or ?, else part of the name; letters count in either case."""
    pattern = pattern.lower()
    return F.col("name_lc").rlike(T.glob_regex(pattern)) if set("*?") & set(pattern) else F.contains(F.col("name_lc"), F.lit(pattern))


def path_condition(value: str) -> Column:
    words = T.query_tokens(value)
    if not words:
        return F.lit(True)
    prefix = value.endswith("*") and len(words) == 1
    return F.contains(T.joined(T.tokens(F.col("parent"))), F.lit(f" {' '.join(words)}" + ("" if prefix else " ")))


def under(folder: str) -> Column:
    folder = T.filter_form(folder).rstrip("/")
    return F.startswith(F.col("dir"), F.lit(folder + "/")) if folder else F.lit(True)


def in_range(col: str, bounds: tuple) -> Column:
    """A half-open range; without bounds everything, with crossed bounds nothing."""
    lo, hi = bounds
    if lo is not None and hi is not None and lo >= hi:
        return F.lit(False)
    out = F.lit(True)
    if lo is not None:
        out = out & (F.col(col) >= lo)
    return out & (F.col(col) < hi) if hi is not None else out


def field_condition(f: Q.Field) -> Column:
    if f.name in ("ext", "kind"):
        return F.col(f.name).isin(*f.value) if f.value else F.lit(True)
    if f.name == "name":
        return name_condition(f.value[0])
    if f.name == "path":
        return path_condition(f.value[0])
    if f.name == "in":
        return under(f.value[0])
    return in_range({"modified": "mtime", "size": "size"}[f.name], f.value)


def ui_filters(exts=(), kinds=(), dirs=(), modified_after=None, modified_before=None, size_min=None, size_max=None) -> Column:
    """The structured filters of a request, all of which must hold; size_max is included."""
    out = in_range("mtime", (modified_after, modified_before)) & in_range("size", (size_min, None if size_max is None else size_max + 1))
    if exts:
        out = out & F.col("ext").isin(*exts)
    if kinds:
        out = out & F.col("kind").isin(*kinds)
    return out & reduce(or_, map(under, dirs)) if dirs else out


def needed(node) -> bool:
    return Q.has_text(node) if node is not None else False


def smart(df: DataFrame, query: str, whole_word: bool = False, case_sensitive: bool = False, filters: Column | None = None, now=None) -> DataFrame:
    """The rows of ``df`` that a query matches. Cheap filters stand before the text, so that they reach the scan."""
    node = Q.parse(query, now)
    if filters is not None:
        df = df.filter(filters)
    fields = FIELDS
    text = needed(node)
    found = condition(node, whole_word, case_sensitive, fields)
    if found is None:
        return df
    return analysed(df, fields, case_sensitive, T.is_arabic(query)).filter(found).drop(*[f"__{k}{f}" for f in fields for k in ("", "bare_")]) if text else df.filter(found)


def literal_regex(literal: str, case_sensitive: bool = False, whole_word: bool = False) -> str:
    """The parts of a literal with any white space between them; word bounds where its ends are letters or digits."""
    parts = literal.split()
    body = r"\s+".join(re.sub(r"([\\.^$|()\[\]{}+*?\-])", r"\\\1", p) for p in parts)
    if whole_word and parts:
        body = (r"(?<![\p{L}\p{N}_])" if parts[0][0].isalnum() else "") + body + (r"(?![\p{L}\p{N}_])" if parts[-1][-1].isalnum() else "")
    return ("" if case_sensitive else "(?iu)") + body


def exact_hit(literal: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """Whether the content or the name of a row has the literal; true for one of white space."""
    if not literal.strip():
        return F.lit(True)
    pattern = literal_regex(literal, case_sensitive, whole_word)
    return F.coalesce(F.col("content").rlike(pattern), F.lit(False)) | F.col("name").rlike(pattern)


def exact(df: DataFrame, literal: str, case_sensitive: bool = False, whole_word: bool = False) -> DataFrame:
    """Rows whose content or name has the literal. Its inner words select candidates before the expression verifies them;
    words with i, k or s do not, where case does not count, since other letters fold to these."""
    fields, rest = Q.split_filters(literal)
    for f in fields:
        df = df.filter(field_condition(f))
    if not rest.strip():
        return df
    pattern = literal_regex(rest, case_sensitive, whole_word)
    inner = [t for t in rest.split() ][1:-1]  # whole words of the literal, so of the text
    inner = [t for t in inner if t.isascii() and t.isalnum() and (case_sensitive or not set("iksIKS") & set(t))]
    cheap = reduce(and_, [F.contains("content", F.lit(w)) if case_sensitive else F.contains(F.lower("content"), F.lit(w.lower())) for w in inner], F.lit(True))
    return df.filter((cheap & F.col("content").rlike(pattern)) | F.col("name").rlike(pattern))


def filename(df: DataFrame, query: str) -> DataFrame:
    fields, rest = Q.split_filters(query)
    for cond in [*map(field_condition, fields), *map(name_condition, rest.split())]:
        df = df.filter(cond)
    return df


def name_score(words: list[str]) -> Column:
    """How many of the words of a name query stand in the name as whole words of their own."""
    tokens = [t for w in words for t in T.query_tokens(w.strip("*?"))]
    own = T.tokens(F.col("name"))
    return reduce(lambda a, b: a + b, [F.array_contains(own, t).cast("int") for t in tokens], F.lit(0))
