"""Pattern queries in linear time: RE2 over Arrow batches, after a prefilter by what every match must contain."""

from __future__ import annotations

import re
import re._constants as C
import re._parser as P
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import query as Q
from .scan import field_condition

MOST = 2000
#: What a class stands for within brackets, for all scripts. Fixed values.
INSIDE = {"w": r"\p{L}\p{M}\p{N}_", "d": r"\p{Nd}", "D": r"\P{Nd}", "s": r"\t-\r\x{85}\p{Z}"}
#: The same for classes that are no union of others: what must not be.
OUTSIDE = {"W": INSIDE["w"], "S": INSIDE["s"]}
_WORD = f"[{INSIDE['w']}]"
#: A bracket with all that belongs to it, an escape, or any other character.
_ATOMS = re.compile(r"\[\^?\]?(?:\[:\^?\w+:\]|\\[pP]\{[^}]*\}|\\.|[^\]\\])*\]|\\[pP]\{[^}]*\}|\\x\{[0-9A-Fa-f]*\}|\\Q.*?(?:\\E|$)|\\.|.", re.S)


def unicode_classes(pattern: str) -> str:
    """The pattern with \\w, \\d and \\s for all scripts, in brackets as well, and \\b at its ends for all scripts."""
    atoms = _ATOMS.findall(pattern)
    out = []
    for i, a in enumerate(atoms):
        if a[0] == "[" and len(a) > 1:
            out.append(bracket(a))
        elif a == "\\b" and i == 0 and wordy(atoms, 1, 1):
            out.append(f"(?:^|[^{INSIDE['w']}])")
        elif a == "\\b" and i == len(atoms) - 1 and wordy(atoms, i - 1, -1):
            out.append(f"(?:$|[^{INSIDE['w']}])")
        elif len(a) == 2 and a[0] == "\\" and a[1] in INSIDE:
            out.append(f"[{INSIDE[a[1]]}]")
        elif len(a) == 2 and a[0] == "\\" and a[1] in OUTSIDE:
            out.append(f"[^{OUTSIDE[a[1]]}]")
        else:
            out.append(a)
    return "".join(out)


def wordy(atoms: list[str], at: int, step: int) -> bool:
    """Whether the atom beside a word edge is a letter, a digit or a class of them, whatever repeats it; a pattern with
    alternatives outside of brackets has other ends, and keeps the plain edge."""
    depth = 0
    for a in atoms:
        depth += (a == "(") - (a == ")")
        if a == "|" and not depth:
            return False
    while 0 <= at < len(atoms) and (atoms[at] in ("(", ")", "?", ":") or step < 0 and atoms[at] in ("+", "*", "}", "{", ",") or step < 0 and atoms[at].isdigit() and "{" in atoms[:at]):
        at += step
    return 0 <= at < len(atoms) and (atoms[at].isalnum() or atoms[at] in ("\\w", "\\d") or atoms[at].startswith("[") and atoms[at] != "[")


def bracket(a: str) -> str:
    """A bracket whose classes count for all scripts."""
    negated = a.startswith("[^")
    body = a[2:-1] if negated else a[1:-1]
    parts = re.findall(r"\[:\^?\w+:\]|\\[pP]\{[^}]*\}|\\.|.", body, re.S)
    lacking = [p for p in parts if len(p) == 2 and p[0] == "\\" and p[1] in OUTSIDE]
    rest = "".join(f"{INSIDE[p[1]]}" if len(p) == 2 and p[0] == "\\" and p[1] in INSIDE else p for p in parts if p not in lacking)
    if not lacking:
        return f"[{'^' if negated else ''}{rest}]"
    if not negated:
        return "(?:" + "|".join([*([f"[{rest}]"] if rest else []), *(f"[^{OUTSIDE[p[1]]}]" for p in lacking)]) + ")"
    return ranges(body)


@lru_cache(64)
def ranges(body: str) -> str:
    """The characters that a negated bracket with a negated class leaves, spelled out: an expression cannot intersect classes."""
    own = re.compile("[" + body.replace(r"\W", "").replace(r"\S", "") + "]") if body.replace(r"\W", "").replace(r"\S", "") else None
    word, space = r"\W" in body, r"\S" in body
    out: list[list[int]] = []
    for cp in range(0x110000):
        c = chr(cp)
        if 0xD800 <= cp < 0xE000 or word and not (c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M") or space and not c.isspace() or own and own.match(c):
            continue
        if out and out[-1][1] == cp - 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out) + "]" if out else r"[^\x{0}-\x{10ffff}]"


def compiled(pattern: str, case_sensitive: bool = False, whole_word: bool = False) -> str:
    """What RE2 gets. Patterns over 2,000 characters, look-around and back-references are errors."""
    if len(pattern) > MOST:
        raise Q.QueryError("the pattern is too long")
    body = unicode_classes(pattern)
    if whole_word:
        body = rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{body})(?:$|[^\p{{L}}\p{{N}}_])"
    out = ("(?m)" if case_sensitive else "(?mi)") + body
    try:
        pc.match_substring_regex(pa.array([""]), out)
    except pa.ArrowInvalid as e:
        raise Q.QueryError(f"not a pattern: {e}") from None
    return out


def required_literals(pattern: str) -> list[str]:
    """Literal runs of three ASCII letters or digits or more that are in every match. Empty where there is no sure one."""
    try:
        tree = P.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    out: list[str] = []

    def run(items) -> None:
        word: list[str] = []

        def close():
            if len(word) >= 3:
                out.append("".join(word))
            word.clear()

        for op, arg in items:
            if op is C.LITERAL and chr(arg).isascii() and chr(arg).isalnum():
                word.append(chr(arg))
                continue
            close()
            if op is C.SUBPATTERN and not arg[1] and not arg[2]:
                run(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                run(arg[2])
        close()

    run(tree)
    return out


def regex_hit(pattern: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """Whether the content or the name of a row has a match; true without a pattern."""
    if not pattern:
        return F.lit(True)
    expression = compiled(pattern, case_sensitive, whole_word)

    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        return pc.fill_null(pc.match_substring_regex(pa.array(texts, pa.string()), expression), False).to_pandas()

    return hit("content") | hit("name")


def regex_scan(df: DataFrame, pattern: str, case_sensitive: bool = False, whole_word: bool = False, prefilter: bool = True) -> DataFrame:
    """Rows whose content or name matches. The prefilter runs in the JVM and changes no result."""
    fields, rest = Q.split_filters(pattern)
    for f in fields:
        df = df.filter(field_condition(f))
    if not rest:
        return df
    hit = regex_hit(rest, case_sensitive, whole_word)
    if prefilter:
        for w in required_literals(rest):
            if not case_sensitive and set("ksKS") & set(w):  # two other letters fold to these
                continue
            df = df.filter(F.contains(F.lower("content"), F.lit(w.lower())) | F.contains("name_lc", F.lit(w.lower())))
    return df.filter(hit)
