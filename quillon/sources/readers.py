"""Readers of document formats: bytes to text, anchors and metadata. They use the standard library only."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.excerpt import cell_of
from .compound import doc, encrypted, msg, ppt, xls
from .pdf import pdf
from .scan import HEAD, route, sniff
from .sink import MOST_CHARS, ReadError, Sink, Stop

NESTING, EMBEDDED_BYTES = 4, 64 << 20
ZIP_ENTRIES, ZIP_RATIO, ZIP_RATIO_FROM, ZIP_TOTAL = 10_000, 250, 1 << 20, 1 << 30
GAP = 64
BLOCK_TAGS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table title tr ul".split())
SKIPPED_TAGS = frozenset("script style template svg math".split())


def decoded(data: bytes) -> str:
    """Text of unknown encoding: byte order mark, UTF-16 without one, UTF-8, else Windows-1252."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace")
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return data.decode("utf-16", "replace")
    if sniff(data) == "utf16":
        return data.decode("utf-16-le" if data[1::2].count(0) > data[::2].count(0) else "utf-16-be", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        return data[: e.start].decode("utf-8") if e.reason == "unexpected end of data" and e.start else data.decode("cp1252", "replace")


def plain(data: bytes, sink: Sink, depth: int = 0) -> None:
    sink.write(decoded(data))


class _Html(HTMLParser):
    def __init__(self, sink: Sink):
        super().__init__(convert_charrefs=True)
        self.sink, self.skip, self.title, self.space = sink, [], None, True

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED_TAGS:
            self.skip.append(tag)
        elif self.skip:
            return
        elif tag == "title":
            self.title = []
        elif tag in BLOCK_TAGS:
            self.break_()

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK_TAGS and not self.skip:
            self.break_()

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                del self.skip[self.skip.index(tag) :]
        elif tag == "title" and self.title is not None:
            self.sink.meta.title = self.sink.meta.title or " ".join("".join(self.title).split())
            self.title = None
        elif tag in ("td", "th"):
            self.sink.write("\t")
            self.space = True
        elif tag in BLOCK_TAGS:
            self.break_()

    def break_(self):
        self.sink.line()
        self.space = True

    def handle_data(self, data):
        if self.skip:
            return
        if self.title is not None:
            self.title.append(data)
            return
        text = re.sub(r"[ \t\r\n\f]+", " ", data)
        if self.space:
            text = text.lstrip(" ")
        if text:
            self.space = text.endswith(" ")
            self.sink.write(text)


def html(data: bytes, sink: Sink, depth: int = 0) -> None:
    """Text without tags, scripts and styles; blocks begin lines; the title is metadata."""
    m = re.search(rb"""charset\s*=\s*["']?([\w-]+)""", data[:2048], re.I)
    text = None
    if m and not data.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
        try:
            text = data.decode(m[1].decode(), "replace")
        except LookupError:
            pass
    parser = _Html(sink)
    parser.feed(decoded(data) if text is None else text)
    parser.close()


def walk_xml(data: bytes, start=None, end=None, text=None, strict: bool = False) -> None:
    """Expat events. Entities that a document defines are never expanded; damage ends the walk."""
    p = expat.ParserCreate(namespace_separator="}")
    p.buffer_text = True
    p.StartElementHandler = start
    p.EndElementHandler = end
    p.CharacterDataHandler = text
    p.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    p.EntityDeclHandler = lambda *a: None
    p.DefaultHandler = lambda s: None  # keeps internal entities unexpanded
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        if strict:
            raise ReadError(str(e)) from None


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def xml(data: bytes, sink: Sink, depth: int = 0) -> None:
    """Text and attribute values under 2,048 characters; the first title is metadata as well."""
    stack: list[str] = []
    title: list[str] = []

    def start(tag, attrs):
        stack.append(local(tag).lower())
        sink.line()
        for v in attrs.values():
            if v.strip() and len(v) < 2048:
                sink.write(v + " ")

    def end(tag):
        if stack and stack.pop() == "title" and title and not sink.meta.title:
            sink.meta.title = " ".join("".join(title).split())
        sink.line()

    def chars(s):
        if stack and stack[-1] == "title":
            title.append(s)
        if s.strip():
            sink.write(s)

    walk_xml(data, start, end, chars)


_JSON = re.compile(r'"((?:[^"\\]|\\.)*)(?:"|$)(\s*:)?|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|([\[\]{}])', re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": " ", "f": " "}


def _unescape_json(s: str) -> str:
    out = re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), s, flags=re.S)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def json(data: bytes, sink: Sink, depth: int = 0) -> None:
    """Keys, strings and numbers; true, false and null are left out. Damaged input gives what is there."""
    for m in _JSON.finditer(decoded(data)):
        if m[1] is not None:
            sink.write(_unescape_json(m[1]) + (": " if m[2] else "\n"))
        elif m[3]:
            sink.write(m[3] + "\n")


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|([\r\n]+)|([^\\{}\r\n]+)", re.S)
RTF_SKIPPED = frozenset("fonttbl colortbl stylesheet listtable listoverridetable pict object themedata datastore generator rsidtbl xmlnstbl filetbl revtbl".split())
RTF_INFO = {"title": "title", "author": "author", "subject": "subject", "keywords": "keywords"}


def rtf(data: bytes, sink: Sink, depth: int = 0) -> None:
    """Visible text; \\'hh and \\u characters; picture, font and style groups are skipped; the info group is metadata."""
    text = data.decode("latin-1")
    if not text.startswith("{\\rtf"):
        raise ReadError("no RTF")
    page = "cp1252"
    stack: list[tuple] = []
    skip, uc, target = False, 1, None
    info: dict[str, list[str]] = {}
    pending = bytearray()
    at = drop = 0

    def emit(s: str):
        nonlocal drop
        if drop:
            n = min(drop, len(s))
            drop, s = drop - n, s[n:]
        if s and not skip:
            info.setdefault(target, []).append(s) if target else sink.write(s)

    def flush():
        if pending:
            emit(pending.decode(page, "replace"))
            pending.clear()

    while at < len(text):
        m = _RTF.match(text, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        word, number, code, symbol, brace, _, run = m.groups()
        if code:
            if drop:
                drop -= 1
            else:
                pending.append(int(code, 16))
            continue
        flush()
        if brace == "{":
            if len(stack) > 100_000:
                raise Stop
            stack.append((skip, uc, target))
        elif brace == "}":
            skip, uc, target = stack.pop() if stack else (skip, uc, target)
        elif run:
            emit(run)
        elif symbol:
            skip = True if symbol == "*" else skip
            if symbol in "\\{}":
                emit(symbol)
            elif symbol == "~":
                emit(" ")
        elif word:
            if word in RTF_SKIPPED:
                skip = True
            elif word == "info":
                target = "__info"
            elif target and word in RTF_INFO:
                target = RTF_INFO[word]
            elif word in ("par", "line", "sect", "page", "row"):
                emit("\n")
            elif word in ("tab", "cell"):
                emit("\t")
            elif word == "u" and number:
                emit(chr(int(number) % 65536))
                drop = uc
            elif word == "uc" and number:
                uc = int(number)
            elif word == "ansicpg" and number:
                page = f"cp{number}" if number != "0" else page
            elif word == "bin" and number:
                at += max(0, int(number))
            elif word in ("emdash", "endash", "bullet", "lquote", "rquote", "ldblquote", "rdblquote"):
                emit({"emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}[word])
    flush()
    for k in RTF_INFO.values():
        setattr(sink.meta, k, "".join(info.get(k, [])).strip())


class SafeZip:
    """A zip whose entries, ratios and total output are bounded while it is read."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
            raise ReadError(f"no zip: {e}") from None
        if len(self.zip.infolist()) > ZIP_ENTRIES:
            raise ReadError("too many entries")
        self.left = ZIP_TOTAL

    def names(self) -> list[str]:
        return self.zip.namelist()

    def read(self, name: str, most: int = EMBEDDED_BYTES) -> bytes | None:
        """An entry's bytes; None if it is not there. Encrypted and suspicious entries are errors."""
        try:
            info = self.zip.getinfo(name)
        except KeyError:
            return None
        if info.flag_bits & 1:
            raise ReadError("encrypted", "encrypted")
        if info.file_size > ZIP_RATIO_FROM and info.file_size > ZIP_RATIO * max(1, info.compress_size):
            raise ReadError("compressed beyond belief")
        try:
            with self.zip.open(info) as f:
                data = f.read(min(most, self.left) + 1)
        except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError, RuntimeError) as e:
            raise ReadError(f"{name}: {e}") from None
        except Exception as e:  # zlib.error and others of damaged streams
            raise ReadError(f"{name}: {e}") from None
        if len(data) > min(most, self.left):
            raise ReadError("too large when unpacked")
        self.left -= len(data)
        return data


def core_properties(z: SafeZip, sink: Sink, name: str = "docProps/core.xml") -> None:
    data, here = z.read(name), []
    names = {"title": "title", "creator": "author", "subject": "subject", "keywords": "keywords", "keyword": "keywords", "initial-creator": "author"}
    if not data:
        return

    def chars(s):
        if here and (k := names.get(here[-1])):
            setattr(sink.meta, k, (getattr(sink.meta, k) + s).strip("\n"))

    walk_xml(data, lambda t, a: here.append(local(t)), lambda t: here.pop() if here else None, chars)


def relations(z: SafeZip, part: str) -> dict[str, str]:
    """Relation ids of an office part and the entries that they name."""
    folder, _, name = part.rpartition("/")
    out: dict[str, str] = {}

    def start(tag, a):
        if local(tag) == "Relationship" and a.get("TargetMode") != "External":
            to = a.get("Target", "")
            path = to.lstrip("/") if to.startswith("/") else f"{folder}/{to}"
            bits: list[str] = []
            for b in path.split("/"):
                bits.pop() if b == ".." and bits else bits.append(b) if b not in (".", "..", "") else None
            out[a.get("Id", "")] = "/".join(bits)

    walk_xml(z.read(f"{folder}/_rels/{name}.rels") or b"<x/>", start)
    return out


def _paragraphs(data: bytes, sink: Sink) -> None:
    """Runs of text of a word or slide part: paragraphs and rows are lines, cells and tabs are tabs."""
    inside = [0]

    def start(tag, a):
        t = local(tag)
        if t == "t":
            inside[0] += 1
        elif t in ("tab",):
            sink.write("\t")
        elif t in ("br", "cr"):
            sink.write("\n")

    def end(tag):
        t = local(tag)
        if t == "t":
            inside[0] -= 1
        elif t == "p":
            sink.line()
        elif t == "tc":
            sink.write("\t")

    walk_xml(data, start, end, lambda s: sink.write(s) if inside[0] else None)


def docx(data: bytes, sink: Sink, depth: int = 0) -> None:
    z = SafeZip(data)
    core_properties(z, sink)
    body = z.read("word/document.xml")
    if body is None:
        raise ReadError("no document part")
    _paragraphs(body, sink)
    for label, pattern in (("Footnotes", "footnotes"), ("Endnotes", "endnotes"), ("Comments", "comments"), ("Header", r"header\d*"), ("Footer", r"footer\d*")):
        for name in sorted(n for n in z.names() if re.fullmatch(rf"word/{pattern}\.xml", n)):
            sink.line()
            sink.anchor("Section", 0, label)
            _paragraphs(z.read(name) or b"", sink)


def pptx(data: bytes, sink: Sink, depth: int = 0) -> None:
    z = SafeZip(data)
    core_properties(z, sink)
    order: list[str] = []
    show, rel = z.read("ppt/presentation.xml"), relations(z, "ppt/presentation.xml")
    if show is None:
        raise ReadError("no presentation part")
    walk_xml(show, lambda t, a: order.append(rel.get(next((v for k, v in a.items() if k.endswith("relationships}id")), ""), "")) if local(t) == "sldId" else None)
    for n, part in enumerate([p for p in order if p], 1):
        slide = z.read(part)
        if slide is None:
            continue
        title, state = [], {"title": False, "t": False}

        def start(tag, a, state=state):
            t = local(tag)
            if t == "sp":
                state["title"] = False
            elif t == "ph" and a.get("type") in ("title", "ctrTitle"):
                state["title"] = True
            elif t == "t":
                state["t"] = True

        def end(tag, state=state):
            if local(tag) == "t":
                state["t"] = False

        walk_xml(slide, start, end, lambda s, state=state, title=title: title.append(s) if state["t"] and state["title"] else None)
        sink.line()
        sink.anchor("Slide", n, " ".join("".join(title).split()))
        _paragraphs(slide, sink)
        for notes in (v for v in relations(z, part).values() if "notesSlide" in v):
            sink.line()
            _paragraphs(z.read(notes) or b"", sink)


class RowWriter:
    """Rows as lines, cells at their places by tabs. Gaps of over 64 cells shrink; jumps of rows set anchors."""

    def __init__(self, sink: Sink):
        self.sink, self.next = sink, 0

    def row(self, number: int, cells: list[tuple[int, str]]) -> None:
        if not cells:
            return
        self.sink.line()
        if number != self.next:
            self.sink.anchor("Row", number + 1)
        col = 0
        for at, value in sorted(cells):
            self.sink.write("\t" * min(max(0, at - col), GAP))
            self.sink.write(re.sub(r"[\t\r\n]", " ", value))
            col = at
        self.sink.write("\n")
        self.next = number + 1


def shared_strings(data: bytes, most: int = 32 << 20) -> list[str]:
    out: list[str] = []
    state = {"parts": None, "t": False, "phonetic": 0, "size": 0}

    def start(tag, a):
        t = local(tag)
        if t == "si":
            state["parts"] = []
        elif t == "rPh":
            state["phonetic"] += 1
        state["t"] = t == "t" and not state["phonetic"]

    def end(tag):
        t = local(tag)
        if t == "si":
            out.append("".join(state["parts"]))
        elif t == "rPh":
            state["phonetic"] -= 1
        state["t"] = False

    def chars(s):
        if state["t"] and state["parts"] is not None:
            state["size"] += len(s)
            if state["size"] > most:
                raise ReadError("too many shared strings")
            state["parts"].append(s)

    walk_xml(data, start, end, chars)
    return out


def xlsx(data: bytes, sink: Sink, depth: int = 0) -> None:
    """Sheets in order, the cells' values: strings, numbers, TRUE and FALSE; formulas are not text."""
    z = SafeZip(data)
    core_properties(z, sink)
    book, rel = z.read("xl/workbook.xml"), relations(z, "xl/workbook.xml")
    if book is None:
        raise ReadError("no workbook part")
    sheets: list[tuple[str, str]] = []
    walk_xml(book, lambda t, a: sheets.append((a.get("name", ""), rel.get(next((v for k, v in a.items() if k.endswith("relationships}id")), ""), ""))) if local(t) == "sheet" else None)
    strings = shared_strings(z.read("xl/sharedStrings.xml") or b"<x/>")
    for number, (name, part) in enumerate(sheets, 1):
        body = z.read(part)
        if body is None:
            continue
        sink.line()
        sink.anchor("Sheet", number, name)
        rows, cells, st = RowWriter(sink), [], {"row": -1, "col": -1, "type": "", "v": None}

        def start(tag, a, st=st, cells=cells):
            t = local(tag)
            if t == "row":
                st["row"], st["col"] = int(a["r"]) - 1 if a.get("r", "").isdigit() else st["row"] + 1, -1
                cells.clear()
            elif t == "c":
                at = cell_of(a.get("r", ""))
                st["col"], st["type"] = at[1] if at else st["col"] + 1, a.get("t", "")
            elif t in ("v", "t"):
                st["v"] = []

        def end(tag, st=st, cells=cells, rows=rows):
            t = local(tag)
            if t in ("v", "t") and st["v"] is not None:
                v, st["v"] = "".join(st["v"]), None
                if st["type"] == "s":
                    v = strings[int(v)] if v.isdigit() and int(v) < len(strings) else ""
                elif st["type"] == "b":
                    v = "TRUE" if v == "1" else "FALSE"
                if v:
                    cells.append((st["col"], v))
            elif t == "row":
                rows.row(st["row"], cells)

        walk_xml(body, start, end, lambda s, st=st: st["v"].append(s) if st["v"] is not None else None)


def odf(data: bytes, sink: Sink, depth: int = 0) -> None:
    """Text, spreadsheets (with repeated cells and rows) and presentations in the open document format."""
    z = SafeZip(data)
    core_properties(z, sink, "meta.xml")
    body = z.read("content.xml")
    if body is None:
        raise ReadError("no content part")
    st: dict = {"sheet": 0, "slide": 0, "rows": None, "row": 0, "cells": [], "col": 0, "cell": None, "repeat": 1, "rowrep": 1, "p": 0}

    def attr(a, name, default="1"):
        return next((v for k, v in a.items() if local(k) == name), default)

    def start(tag, a):
        t = local(tag)
        if t == "table" and "table" in tag:
            st["sheet"] += 1
            sink.line()
            sink.anchor("Sheet", st["sheet"], attr(a, "name", ""))
            st["rows"], st["row"] = RowWriter(sink), 0
        elif t == "page" and "draw" in tag:
            st["slide"] += 1
            sink.line()
            sink.anchor("Slide", st["slide"], attr(a, "name", ""))
        elif t == "table-row" and st["rows"]:
            st["cells"], st["col"], st["rowrep"] = [], 0, int(attr(a, "number-rows-repeated"))
        elif t in ("table-cell", "covered-table-cell") and st["rows"]:
            st["cell"], st["repeat"] = [], int(attr(a, "number-columns-repeated"))
        elif t in ("p", "h"):
            st["p"] += 1
        elif t in ("s", "tab", "line-break") and st["p"]:
            chars({"s": " " * min(GAP, int(attr(a, "c"))), "tab": "\t", "line-break": "\n"}[t])

    def end(tag):
        t = local(tag)
        if t in ("table-cell", "covered-table-cell") and st["cell"] is not None:
            if text := "".join(st["cell"]).strip():
                st["cells"] += [(st["col"] + i, text) for i in range(min(st["repeat"], GAP))]
            st["col"] += st["repeat"]
            st["cell"] = None
        elif t == "table-row" and st["rows"]:
            if st["cells"]:  # a repeated row is written once, as a repeated cell is
                st["rows"].row(st["row"], st["cells"])
            st["row"] += st["rowrep"]
        elif t == "table" and "table" in tag:
            st["rows"] = None
        elif t in ("p", "h"):
            st["p"] -= 1
            st["cell"].append(" ") if st["cell"] is not None else sink.line()

    def chars(s):
        if st["p"]:
            st["cell"].append(s) if st["cell"] is not None else sink.write(s)

    walk_xml(body, start, end, chars)


def epub(data: bytes, sink: Sink, depth: int = 0) -> None:
    z = SafeZip(data)
    root: list[str] = []
    walk_xml(z.read("META-INF/container.xml") or b"<x/>", lambda t, a: root.append(a.get("full-path", "")) if local(t) == "rootfile" else None)
    package = z.read(root[0]) if root else None
    if package is None:
        raise ReadError("no package")
    items, spine, here = {}, [], []

    def start(tag, a):
        t = local(tag)
        here.append(t)
        if t == "item":
            items[a.get("id")] = a.get("href", "")
        elif t == "itemref":
            spine.append(a.get("idref"))

    def chars(s):
        if here and here[-1] in ("title", "creator"):
            k = {"title": "title", "creator": "author"}[here[-1]]
            setattr(sink.meta, k, (getattr(sink.meta, k) + s).strip())

    walk_xml(package, start, lambda t: here.pop() if here else None, chars)
    folder = root[0].rpartition("/")[0]
    for n, ref in enumerate(spine, 1):
        chapter = z.read(f"{folder}/{items.get(ref, '')}".lstrip("/"))
        if chapter is None:
            continue
        inner = Sink(sink.most)
        try:
            html(chapter, inner)
        except Stop:
            pass
        sink.line()
        sink.anchor("Section", n, inner.meta.title or f"Chapter {n}")
        sink.write(inner.text())


def eml(data: bytes, sink: Sink, depth: int = 0) -> None:
    """Headers, bodies, and attachments as parts; messages inside messages likewise."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    _message(message, sink, depth)


def _message(message, sink: Sink, depth: int) -> None:
    def header(name):
        try:
            return str(message.get(name) or "")
        except Exception:  # a damaged header is no reason to lose the message
            return ""

    if not depth:
        sink.meta.title, sink.meta.author = header("subject"), header("from")
    for name in ("Subject", "From", "To", "Cc", "Date"):
        if v := header(name):
            sink.write(f"{name}: {v}\n")
    sink.write("\n")
    shown = False
    for part in message.walk() if not message.is_multipart() else message.iter_parts():
        _part(part, sink, depth, shown)
        shown = True


def _part(part, sink: Sink, depth: int, shown: bool) -> None:
    kind, name = part.get_content_type(), part.get_filename()
    if kind == "message/rfc822" and depth < NESTING:
        sink.line()
        sink.anchor("Part", 0, name or "message")
        for inner in part.iter_parts():
            _message(inner, sink, depth + 1)
    elif part.is_multipart():
        parts = list(part.iter_parts())
        if kind == "multipart/alternative":
            parts = [p for p in parts if p.get_content_type() == "text/plain"][:1] or parts[-1:]
        for p in parts:
            _part(p, sink, depth, shown)
    else:
        try:
            data = part.get_payload(decode=True) or b""
        except (ValueError, LookupError):
            return
        if name:
            embedded(name, data, sink, depth)
        elif kind == "text/html":
            inner = Sink(sink.most)
            html(data, inner)
            sink.write(inner.text())
            sink.line()
        elif kind.startswith("text/"):
            charset = part.get_content_charset() or "utf-8"
            try:
                sink.write(data.decode(charset, "replace"))
            except LookupError:
                sink.write(decoded(data))
            sink.line()


def embedded(name: str, data: bytes, sink: Sink, depth: int) -> None:
    """A document inside another: its name and text as a part, with what is left of the sink."""
    sink.line()
    sink.anchor("Part", 0, name)
    sink.write(name + "\n")
    if depth >= NESTING or len(data) > EMBEDDED_BYTES:
        return
    reader = route(name.rpartition(".")[2].lower(), sniff(data), data=data)
    if reader not in READERS:
        return
    inner = Sink(max(0, sink.most - sink.size))
    try:
        READERS[reader](data, inner, depth + 1)
    except (Stop, ReadError):
        pass
    base = sink.size
    sink.anchors += [type(a)(base + a.offset, a.kind, a.num, a.label) for a in inner.anchors]
    sink.write(inner.text())


def zip_(data: bytes, sink: Sink, depth: int = 0) -> None:
    z = SafeZip(data)
    for info in z.zip.infolist():
        if info.is_dir():
            continue
        name = info.filename
        if not info.flag_bits & 0x800:  # not marked as UTF-8, which many writers forget
            try:
                name = name.encode("cp437").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
        try:
            embedded(name, z.read(info.filename) or b"", sink, depth)
        except ReadError:
            sink.line()
            sink.write(name + "\n")


READERS = {"pdf": pdf, "doc": doc, "xls": xls, "ppt": ppt, "msg": msg, "encrypted": encrypted, "plain": plain, "html": html, "xml": xml, "json": json, "rtf": rtf, "docx": docx, "pptx": pptx, "xlsx": xlsx, "odf": odf, "epub": epub, "eml": eml, "zip": zip_}


def extract(name: str, data: bytes | None, most: int = MOST_CHARS) -> dict:
    """Text, anchors, metadata and status of one file. Whatever is wrong with it ends in a status, never in an error."""
    data = data or b""
    out = {"content": "", "title": None, "author": None, "meta": "", "status": "indexed", "reason": None, "truncated": False, "anchors": []}
    reader = route(name.rpartition(".")[2].lower() if "." in name else "", sniff(data[:HEAD]), data=data)
    if reader is None or reader not in READERS:
        return out | {"status": "name_only", "reason": None if reader is None else f"no reader for {reader}"}
    sink = Sink(most)
    try:
        READERS[reader](data, sink)
    except Stop:
        pass
    except ReadError as e:
        return out | {"status": e.status, "reason": str(e)}
    except Exception as e:  # a reader's failure concerns one file only
        return out | {"status": "failed", "reason": f"{type(e).__name__}: {e}"}
    return out | {
        "content": sink.text(), "title": sink.meta.title or None, "author": sink.meta.author or None, "meta": sink.meta.text(), "truncated": sink.truncated, "status": "needs_ocr" if sink.needs_ocr else "indexed",
        "anchors": [{"offset": a.offset, "kind": a.kind, "num": a.num, "label": a.label} for a in sink.anchors],
    }


TYPE = "content string, title string, author string, meta string, status string, reason string, truncated boolean, anchors array<struct<offset:int,kind:string,num:int,label:string>>"
_ANCHORS = pa.list_(pa.struct([("offset", pa.int32()), ("kind", pa.string()), ("num", pa.int32()), ("label", pa.string())]))


def extracted(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """All other columns of ``files`` with what its readers get from each row's bytes."""
    keep = [c for c in files.columns if c not in (content, "title", "author", "meta", "status", "reason", "truncated", "anchors")]
    src = files.select(*keep, F.col(name).alias("__name"), F.col(content).cast("binary").alias("__bytes"))
    fields = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    kinds = {"truncated": pa.bool_(), "anchors": _ANCHORS}
    columns = ("content", "title", "author", "meta", "status", "reason", "truncated", "anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in _slices(whole)):
            got = [extract(n or "", d) for n, d in zip(batch.column("__name").to_pylist(), batch.column("__bytes").to_pylist())]
            cols = [pa.array([g[c] for g in got], kinds.get(c, pa.string())) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + cols, names=[*keep, *columns])

    return src.mapInArrow(run, f"{fields}, {TYPE}")


def _slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose files have about ``most`` bytes."""
    start = total = 0
    for i, x in enumerate(batch.column("__bytes")):
        n = len(x.as_buffer() or b"") if x.is_valid else 0
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


#: Entities of titles that are decoded in the JVM; the ampersand last. Fixed values.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def html_title(markup):
    """The title of web pages, in the JVM: tags out, common entities decoded, white space as one space."""
    inner = F.regexp_replace(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]*>", "")
    for a, b in ENTITIES.items():
        inner = F.replace(inner, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(inner, r"\s+", " "))


__all__ = ["READERS", "extract", "extracted", "html_title"]
