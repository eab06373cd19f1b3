"""Text analysis for every script: words, folding, articles; as Columns that run in the JVM, and for single texts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that fold to several letters, or to a base letter that decomposition does not give. Fixed values.
WIDE = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
SINGLE = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ı": "i"}
#: Arabic: removed, and letter to letter. Fixed values.
TATWEEL = "ـ"
ARABIC = {"ٱ": "ا", "ة": "ه", "ى": "ي", "ی": "ي", "ک": "ك"}
#: Definite articles and their joined forms; the first that matches decides. Fixed values.
ARTICLES = ("وال", "بال", "كال", "فال", "لل", "ال")
MOST = 64
#: Blocks whose characters are words of their own (first and last code point). Fixed values.
IDEOGRAPHS = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x2FA1F))


def is_ideograph(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in IDEOGRAPHS)


def normalize(word: str) -> str:
    """The folded form of a word of any script. Korean syllables stay whole."""
    out = []
    for c in word.lower():
        if c in WIDE:
            out.append(WIDE[c])
        elif c in SINGLE:
            out.append(SINGLE[c])
        else:
            for d in c if "\uac00" <= c <= "\ud7a3" else unicodedata.normalize("NFD", c):
                if unicodedata.category(d)[0] == "M" or d == TATWEEL:
                    continue
                digit = unicodedata.decimal(d, None) if not d.isascii() else None
                out.append(str(digit) if digit is not None and ("٠" <= d <= "٩" or "۰" <= d <= "۹") else ARABIC.get(d, d))
    return "".join(out)


def _folding() -> tuple[str, str]:
    """Lower-case characters of all scripts that fold to one other, and those; what folds to nothing stands at the end."""
    pairs, gone = {}, []
    for cp in [*range(0xC0, 0x3100), *range(0xF900, 0xFB50)]:
        c = chr(cp)
        if c in WIDE or c.lower() != c or unicodedata.category(c)[0] == "M":
            continue
        to = normalize(c)
        if not to:
            gone.append(c)
        elif len(to) == 1 and to != c:
            pairs[c] = to
    return "".join(pairs) + "".join(gone), "".join(pairs.values())


FOLDING = _folding()


def fold(text: Column) -> Column:
    """Lower case without marks, for every script; runs in the JVM. ``normalize`` is the same for one word."""
    out = F.lower(text)
    for a, b in WIDE.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(out, *FOLDING), r"\p{M}+", "")


_OWN = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in IDEOGRAPHS)
#: A word: an ideograph alone, or a run of other letters, digits and the marks behind them.
WORD = rf"[{_OWN}]|[\p{{L}}\p{{N}}&&[^{_OWN}]][\p{{L}}\p{{N}}\p{{M}}&&[^{_OWN}]]*"


def words(text: Column) -> Column:
    """The words of a text as they stand, longest 64 characters."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0), lambda w: F.length(w) <= MOST)


def tokens(text: Column) -> Column:
    """Folded words of a text of any script. Null has none."""
    return words(fold(F.coalesce(text, F.lit(""))))


def joined(tokens_: Column) -> Column:
    """Tokens between single spaces, with one at both ends: what phrase and prefix tests look into."""
    return F.concat(F.lit(" "), F.array_join(tokens_, " "), F.lit(" "))


def bare(token: Column) -> Column:
    """A token without its Arabic article, if three letters remain; the first article that it begins with decides."""
    out = F
    for a in ARTICLES:
        out = out.when(F.startswith(token, F.lit(a)), F.when(F.length(token) >= len(a) + 3, F.substring(token, len(a) + 1, MOST)).otherwise(token))
    return out.otherwise(token)


def is_arabic(text: str) -> bool:
    return any("\u0600" <= c <= "\u06ff" for c in text)


def _word_pattern() -> re.Pattern:
    marks: list[list[int]] = []
    for cp in range(0x300, 0x110000):
        if unicodedata.category(chr(cp))[0] == "M":
            if marks and marks[-1][1] == cp - 1:
                marks[-1][1] = cp
            else:
                marks.append([cp, cp])
    own, mark = ("".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) for ranges in (IDEOGRAPHS, marks))
    return re.compile(rf"[{own}]|[^\W_{own}](?:[^\W_{own}]|[{mark}])*")


_WORDS = _word_pattern()


def spans(text: str) -> list[tuple[int, int]]:
    """(from, to) of the words of any script: runs of letters, digits and the marks after them; an ideograph is a word of
    its own; a run of over 64 characters is no word."""
    return [m.span() for m in _WORDS.finditer(text) if m.end() - m.start() <= MOST]


def without_article(word: str) -> str:
    """An Arabic word without its article, if three letters remain."""
    for a in ARTICLES:
        if word.startswith(a):
            return word[len(a) :] if len(word) - len(a) >= 3 else word
    return word


def query_tokens(text: str) -> list[str]:
    """The tokens that a query looks for."""
    return [t for t in (without_article(normalize(text[a:b])) for a, b in spans(text)) if t]


def index_tokens(text: str) -> list[tuple[int, str]]:
    """(position, token) of a text: an Arabic word stands under its article-less form as well, at the same position."""
    out, pos = [], 0
    for a, b in spans(text):
        word = normalize(text[a:b])
        if not word:
            continue
        out.append((pos, word))
        if (bare := without_article(word)) != word:
            out.append((pos, bare))
        pos += 1
    return out


def positions_udf():
    """text -> array of (pos, term) by the rules for every script, in Arrow batches."""

    @F.pandas_udf("array<struct<pos:int,term:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"pos": p, "term": w} for p, w in index_tokens(t or "")])

    return run


def filter_form(path: str) -> str:
    return path.replace("\\", "/")


def extension(name: Column) -> Column:
    """The lower-cased part after the last dot; empty without a dot or where the name only begins with one."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def glob_regex(pattern: str) -> str:
    """An anchored expression for a glob of * and ?, whose wildcards match any character."""
    return "^(?s:" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([\\.^$|()\[\]{}+*?])", r"\\\1", c) for c in pattern) + ")$"


def utf16_length(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


def resolved(folder: str) -> str:
    """A folder's path without . and .. and doubled slashes, with one slash at its end."""
    out: list[str] = []
    for part in filter_form(folder).split("/"):
        if part == "..":
            out[-1:] = []
        elif part not in ("", "."):
            out.append(part)
    return ("/" if filter_form(folder).startswith("/") else "") + "".join(f"{p}/" for p in out)
