"""The query language: scanner, parser, tree, and the literals of its fields."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from .text import filter_form

MOST_BYTES, MOST_DEPTH = 8192, 64
#: Fields and what they may be called; kinds and theirs. Fixed values.
FIELDS = {
    "filename": "name", "name": "name", "file": "name", "ext": "ext", "extension": "ext", "type": "kind", "kind": "kind", "path": "path",
    "in": "in", "dir": "in", "folder": "in", "modified": "modified", "date": "modified", "mtime": "modified", "size": "size",
}
KINDS = {
    "text": "text", "txt": "text", "code": "code", "source": "code", "data": "data", "web": "web", "html": "web", "pdf": "pdf", "word": "word", "document": "word", "doc": "word",
    "spreadsheet": "spreadsheet", "excel": "spreadsheet", "sheet": "spreadsheet", "presentation": "presentation", "powerpoint": "presentation", "slides": "presentation",
    "ebook": "ebook", "epub": "ebook", "image": "image", "other": "other",
}
UNITS = {"": 0, "b": 0, "k": 1, "kb": 1, "kib": 1, "m": 2, "mb": 2, "mib": 2, "g": 3, "gb": 3, "gib": 3, "t": 4, "tb": 4, "tib": 4}
AGES = {"h": 3600, "d": 86400, "w": 7 * 86400, "m": 30 * 86400, "y": 365 * 86400}


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    text: str
    prefix: bool = False


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class Field:
    """name, ext, kind, path, in: values; modified, size: a half-open range with None for no bound."""

    name: str
    value: tuple


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Own:
    """A node that a user of the library adds to the language, written ``name:value``.

    A subclass says twice what it matches, and both must agree: ``condition`` for a scan, a Column over the joined tokens of
    the fields (``__content`` and so on), and ``rows`` for an index, (doc_id, field, tf) with one row for each document and
    field. Its hits are scored as those of a word are, times ``weight``. It shows no spans.
    """

    value: str
    weight = 1.0

    def condition(self, fields: tuple):
        raise NotImplementedError

    def rows(self, index):
        raise NotImplementedError


OWN: dict[str, type[Own]] = {}


def register(name: str, node: type[Own]) -> None:
    """Adds a node under a name of letters, in either case; the language's own fields cannot be replaced."""
    if not re.fullmatch("[A-Za-z]+", name) or name.lower() in FIELDS:
        raise QueryError(f"not a name for a node: {name}")
    OWN[name.lower()] = node


#: The pieces of a query, tried in this order.
_PIECES = re.compile(
    r"""(?P<space>\s+)|(?P<open>\()|(?P<close>\))|(?P<quote>"(?P<quoted>[^"]*)(?:"|$))|(?P<minus>(?:(?<=^)|(?<=[\s(]))-(?=[^\s]))"""
    r"""|(?P<or>\|\|?)|(?P<and>&&)|(?P<field>(?P<name>[A-Za-z]+):(?P<value>"[^"]*"?|[^\s()"]*))|(?P<word>[^\s()"]+)""",
    re.X,
)


def scan(query: str) -> list[tuple[str, str, str]]:
    """(kind, text, value) of the query's pieces. | and && count only where a piece begins."""
    out, at = [], 0
    while at < len(query):
        m = _PIECES.match(query, at)
        if m is None:
            at += 1
            continue
        kind, text, value = m.lastgroup, m.group(), ""
        if m["quote"] is not None:
            kind, text = "phrase", m["quoted"]
        elif m["field"] is not None:
            if m["name"].lower() in FIELDS:
                kind, text, value = "field", FIELDS[m["name"].lower()], m["value"].strip('"')
            elif m["name"].lower() in OWN:
                kind, text, value = "own", m["name"].lower(), m["value"].strip('"')
            else:
                m = re.compile(r'[^\s()"]+').match(query, at)
                kind, text = "word", m.group()
        elif m["word"] is not None:
            kind = {"AND": "and", "OR": "or", "NOT": "minus"}.get(text, "word")
        else:
            kind = next(k for k in ("space", "open", "close", "minus", "or", "and") if m[k] is not None)
        at = m.end()
        if kind != "space":
            out.append((kind, text, value))
    return out


def parse(query: str, now: datetime | None = None):
    """The tree of a query, None for one without conditions. OR binds weakest, then AND (also unwritten), then NOT."""
    if len(query.encode()) > MOST_BYTES:
        raise QueryError("the query is too long")
    pieces = scan(query)
    level = deepest = 0
    for kind, *_ in pieces:
        level = level + 1 if kind == "open" else max(0, level - 1) if kind == "close" else level
        deepest = max(deepest, level)
    if deepest > MOST_DEPTH:
        raise QueryError("parentheses are nested too deeply")
    parser = _Parser(pieces, now)
    found = []
    while parser.at < len(pieces):
        found.append(parser.any_of(False))
        if parser.at < len(pieces):  # a parenthesis that closes nothing
            parser.at += 1
    return _joined(And, found)


def _joined(kind, parts: list):
    parts = [p for p in parts if p is not None]
    flat = [q for p in parts for q in (p.parts if isinstance(p, kind) else (p,))]
    return None if not flat else flat[0] if len(flat) == 1 else kind(tuple(flat))


class _Parser:
    def __init__(self, pieces: list, now):
        self.pieces, self.at, self.now = pieces, 0, now

    def kind(self) -> str:
        return self.pieces[self.at][0] if self.at < len(self.pieces) else "end"

    def any_of(self, inner: bool):
        parts = [self.all_of(inner)]
        while self.kind() == "or":
            self.at += 1
            parts.append(self.all_of(inner))
        return _joined(Or, parts)

    def all_of(self, inner: bool):
        parts = []
        while self.kind() not in ("or", "close", "end"):
            if self.kind() == "and":
                self.at += 1
            else:
                parts.append(self.one(inner))
        return _joined(And, parts)

    def one(self, inner: bool):
        kind, text, value = self.pieces[self.at]
        self.at += 1
        if kind == "minus":
            negated = False
            while True:
                negated = not negated
                if self.kind() != "minus":
                    break
                self.at += 1
            if self.kind() in ("or", "and", "close", "end"):
                return None
            part = self.one(inner)
            return None if part is None else Not(part) if negated else part
        if kind == "open":
            part = self.any_of(True)
            if self.kind() == "close":
                self.at += 1
            return part
        if kind == "phrase":
            return Phrase(text) if text.strip() else None
        if kind == "field":
            return field(text, value, self.now)
        if kind == "own":
            if not value:
                raise QueryError(f"{text}: needs a value")
            return OWN[text](value)
        if text.endswith("*") and len(text) > 1:
            return Term(text.rstrip("*"), True) if text.rstrip("*") else None
        return Term(text)


def field(name: str, value: str, now: datetime | None = None) -> Field:
    if not value:
        raise QueryError(f"{name}: needs a value")
    if name == "ext":
        return Field(name, tuple(x for x in (p.strip().lstrip("*").lstrip(".").lower() for p in re.split(r"[,|;]", value)) if x))
    if name == "kind":
        kinds = [p.strip().lower() for p in re.split(r"[,|]", value) if p.strip()]
        if bad := [k for k in kinds if k not in KINDS]:
            raise QueryError(f"no such type: {bad[0]}")
        return Field(name, tuple(KINDS[k] for k in kinds))
    if name == "modified":
        return Field(name, modified(value, now))
    if name == "size":
        return Field(name, size(value))
    return Field(name, (filter_form(value) if name == "in" else value,))


def split_filters(query: str, now: datetime | None = None) -> tuple[list[Field], str]:
    """The field conditions of a literal, pattern or name query, and the rest of it as it stands."""
    fields: list[Field] = []

    def take(m: re.Match) -> str:
        if m["name"].lower() not in FIELDS:
            return m.group()
        fields.append(field(FIELDS[m["name"].lower()], m["value"].strip('"'), now))
        return " "

    rest = re.sub(r'(?<!\S)(?P<name>[A-Za-z]+):(?P<value>"[^"]*"?|\S+)', take, query)
    return fields, rest.strip() if fields else query


def _instant(d: date) -> int:
    return int(datetime(d.year, d.month, d.day, tzinfo=timezone.utc).timestamp())


def day_span(text: str, now: datetime | None = None) -> tuple[int, int]:
    """Seconds from and to of a year, month, day, ``today`` or ``yesterday``, in UTC."""
    now = now or datetime.now(timezone.utc)
    if text.lower() in ("today", "yesterday"):
        d = now.date() - timedelta(days=text.lower() == "yesterday")
        return _instant(d), _instant(d + timedelta(days=1))
    m = re.fullmatch(r"(\d{4})(?:[-/.](\d{1,2}))?(?:[-/.](\d{1,2}))?", text)
    try:
        y, mo, d = (int(x) if x else None for x in m.groups())
        first = date(y, mo or 1, d or 1)
        last = first + timedelta(days=1) if d else date(y + (mo or 12) // 12, (mo or 12) % 12 + 1, 1)
    except (AttributeError, ValueError, OverflowError):
        raise QueryError(f"no date: {text}") from None
    return _instant(first), _instant(last)


def modified(value: str, now: datetime | None = None) -> tuple[int | None, int | None]:
    """A half-open range of seconds: a span, a..b, <, <=, >, >= and ages such as 7d (newer) and >7d (older)."""
    now = now or datetime.now(timezone.utc)
    m = re.fullmatch(r"(<=|>=|<|>|=)?\s*(.+)", value)
    op, rest = m.group(1) or "", m.group(2)
    if age := re.fullmatch(r"(\d+)([hdwmy])", rest.lower()):
        at = int(now.timestamp()) - int(age[1]) * AGES[age[2]]
        return (None, at) if op.startswith(">") else (at, None)
    if ".." in rest and not op:
        a, b = rest.split("..", 1)
        return day_span(a, now)[0] if a else None, day_span(b, now)[1] if b else None
    a, b = day_span(rest, now)
    return {"": (a, b), "=": (a, b), ">": (b, None), ">=": (a, None), "<": (None, a), "<=": (None, b)}[op]


def bytes_of(text: str) -> int:
    m = re.fullmatch(r"(\d+(?:\.\d*)?|\.\d+)\s*([a-z]*)", text.strip().lower())
    if not m or m[2] not in UNITS:
        raise QueryError(f"no size: {text}")
    return int(float(m[1]) * 1024 ** UNITS[m[2]])


def size(value: str) -> tuple[int | None, int | None]:
    """A half-open range of bytes. A bare size means at least that; a..b includes b."""
    m = re.fullmatch(r"(<=|>=|<|>|=)?\s*(.+)", value)
    op, rest = m.group(1) or "", m.group(2)
    if ".." in rest and not op:
        a, b = rest.split("..", 1)
        return bytes_of(a) if a else None, bytes_of(b) + 1 if b else None
    n = bytes_of(rest)
    return {"": (n, None), ">=": (n, None), ">": (n + 1, None), "<": (None, n), "<=": (None, n + 1), "=": (n, n + 1)}[op]


def leaves(node, kinds: tuple = (Term, Phrase)) -> list:
    """The words and phrases that a match shows: those not under NOT."""
    if isinstance(node, (And, Or)):
        return [x for p in node.parts for x in leaves(p, kinds)]
    if isinstance(node, Not):
        return []
    return [node] if isinstance(node, kinds) else []


def has_text(node) -> bool:
    if isinstance(node, (And, Or)):
        return any(map(has_text, node.parts))
    return has_text(node.part) if isinstance(node, Not) else isinstance(node, (Term, Phrase, Own))
