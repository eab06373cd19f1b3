"""Text of PDF files, page by page, with the file's information; and which pages are scans.

Objects are found by their own marks rather than by the cross-reference table, so that damaged files are read as far as
they go. Strings become text by the fonts' ToUnicode maps, else by their encodings' Latin code page.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

from .sink import ReadError, Sink

MOST_OBJECTS, MOST_STREAM, MOST_PAGES = 200_000, 64 << 20, 10_000
#: A page is a scan with fewer letters and digits than this and images over this share of its area.
SCAN_LETTERS, SCAN_SHARE = 64, 0.5
_SPACE = b"\0\t\n\x0c\r "
_DELIMITERS = b"()<>[]{}/%"
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass(frozen=True)
class Name:
    value: str


@dataclass(frozen=True)
class Word:
    value: bytes


@dataclass
class Stream:
    head: dict
    raw: bytes


class Lexer:
    """Values of a PDF body from a position on."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def skip(self) -> None:
        data = self.data
        while self.at < len(data):
            c = data[self.at]
            if c in _SPACE:
                self.at += 1
            elif c == 37:
                ends = [x for x in (data.find(b"\n", self.at), data.find(b"\r", self.at)) if x >= 0]
                self.at = min(ends) if ends else len(data)
            else:
                return

    def value(self, depth: int = 0):
        """The next value; None at the end."""
        self.skip()
        data = self.data
        if self.at >= len(data) or depth > 64:
            self.at = len(data)
            return None
        c = data[self.at]
        if c == 47:
            return self._name()
        if c == 40:
            return self._string()
        if data.startswith(b"<<", self.at):
            return self._dictionary(depth)
        if c == 60:
            end = data.find(b">", self.at)
            end = len(data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[self.at : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == 91:
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.at >= len(data) or data[self.at] == 93:
                    self.at += 1
                    return out
                out.append(self.value(depth + 1))
        if c in b")>]}{":
            self.at += 1
            return Word(bytes([c]))
        return self._word()

    def _name(self) -> Name:
        end = self.at + 1
        while end < len(self.data) and self.data[end] not in _SPACE and self.data[end] not in _DELIMITERS:
            end += 1
        raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), self.data[self.at + 1 : end])
        self.at = end
        return Name(raw.decode("latin-1"))

    def _string(self) -> bytes:
        out, level, i, data = bytearray(), 1, self.at + 1, self.data
        while i < len(data) and level:
            c = data[i]
            if c == 92 and i + 1 < len(data):
                i += 1
                e = data[i]
                if 48 <= e <= 55:
                    m = re.compile(rb"[0-7]{1,3}").match(data, i)
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                    continue
                if e in b"\r\n":
                    i += 2 if data[i : i + 2] == b"\r\n" else 1
                    continue
                out.append({110: 10, 114: 13, 116: 9, 98: 8, 102: 12}.get(e, e))
            else:
                level += (c == 40) - (c == 41)
                if level:
                    out.append(c)
            i += 1
        self.at = i
        return bytes(out)

    def _dictionary(self, depth: int) -> dict:
        self.at += 2
        out: dict = {}
        while True:
            self.skip()
            if self.at >= len(self.data) or self.data.startswith(b">>", self.at):
                self.at += 2
                return out
            key = self.value(depth + 1)
            if not isinstance(key, Name):
                continue
            self.skip()
            if self.data.startswith(b">>", self.at):
                continue
            out[key.value] = self.value(depth + 1)

    def _word(self):
        end = self.at
        while end < len(self.data) and self.data[end] not in _SPACE and self.data[end] not in _DELIMITERS:
            end += 1
        raw, self.at = self.data[self.at : end], max(end, self.at + 1)
        if self.refs and raw.isdigit() and (m := re.compile(rb"\s+\d+\s+R(?![A-Za-z0-9])").match(self.data, end)):
            self.at = m.end()
            return Ref(int(raw))
        try:
            return float(raw) if b"." in raw else int(raw)
        except ValueError:
            return {b"true": True, b"false": False, b"null": None}.get(raw, Word(raw))


class Pdf:
    def __init__(self, data: bytes):
        self.data = data
        self.places = {int(m[1]): m.end() for m in _OBJECT.finditer(data)}
        if len(self.places) > MOST_OBJECTS:
            raise ReadError("too many objects")
        self.known: dict = {}
        self.packed: dict[int, tuple[int, int]] = {}
        self.trailer: dict = {}
        for m in re.finditer(rb"\btrailer\b", data):
            found = Lexer(data, m.end()).value()
            if isinstance(found, dict):
                self.trailer |= found
        for n in list(self.places):
            s = self.get(Ref(n)) if data.find(b"/ObjStm", self.places[n], self.places[n] + 400) >= 0 or data.find(b"/XRef", self.places[n], self.places[n] + 400) >= 0 else None
            if isinstance(s, Stream):
                kind = s.head.get("Type")
                if kind == Name("XRef"):
                    self.trailer |= {k: v for k, v in s.head.items() if k in ("Root", "Info", "Encrypt")}
                elif kind == Name("ObjStm"):
                    self._unpack(s)
        if "Encrypt" in self.trailer:
            raise ReadError("encrypted", "encrypted")

    def _unpack(self, s: Stream) -> None:
        body, first = self.content(s), self.get(s.head.get("First"))
        count = self.get(s.head.get("N"))
        if not isinstance(first, int) or not isinstance(count, int):
            return
        head = Lexer(body[:first], 0, False)
        for _ in range(min(count, MOST_OBJECTS)):
            n, at = head.value(), head.value()
            if isinstance(n, int) and isinstance(at, int) and n not in self.places:
                self.known[n] = Lexer(body, first + at).value()

    def get(self, x):
        """A value itself, what a reference stands for included."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self._object(x.number)
        return None

    def _object(self, n: int):
        if n in self.known:
            return self.known[n]
        self.known[n] = None  # what refers to itself is nothing
        at = self.places.get(n)
        if at is None:
            return None
        lex = Lexer(self.data, at)
        value = lex.value()
        lex.skip()
        if isinstance(value, dict) and self.data.startswith(b"stream", lex.at):
            start = lex.at + 6
            start += 2 if self.data.startswith(b"\r\n", start) else 1 if self.data[start : start + 1] in (b"\n", b"\r") else 0
            size = self.get(value.get("Length"))
            if not isinstance(size, int) or not self.data.startswith(b"endstream", start + size + len(self.data[start + size : start + size + 2]) - len(self.data[start + size : start + size + 2].lstrip(b"\r\n"))):
                end = self.data.find(b"endstream", start)
                size = (len(self.data) if end < 0 else end) - start
            value = Stream(value, self.data[start : start + size])
        self.known[n] = value
        return value

    def content(self, s: Stream) -> bytes:
        """A stream's bytes, its filters undone; empty where a filter is for images only."""
        data = s.raw
        filters = self.get(s.head.get("Filter")) or []
        options = self.get(s.head.get("DecodeParms")) or {}
        for k, f in enumerate(filters if isinstance(filters, list) else [filters]):
            name = getattr(self.get(f), "value", "")
            parms = self.get(options[k]) if isinstance(options, list) and k < len(options) else options if isinstance(options, dict) else {}
            if name in ("FlateDecode", "Fl"):
                data = predicted(inflated(data), {a: self.get(b) for a, b in (parms or {}).items()})
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif name in ("ASCII85Decode", "A85"):
                data = ascii85(data)
            elif name in ("RunLengthDecode", "RL"):
                data = run_lengths(data)
            else:
                return b""
        return data

    def pages(self) -> list[dict]:
        """The page dictionaries in order, with what they inherit; all that look like pages where the tree is broken."""
        root = self.get(self.trailer.get("Root"))
        out: list[dict] = []
        if isinstance(root, dict):
            todo, seen = [(root.get("Pages"), {})], set()
            while todo and len(out) < MOST_PAGES:
                ref, above = todo.pop()
                if isinstance(ref, Ref):
                    if ref.number in seen:
                        continue
                    seen.add(ref.number)
                node = self.get(ref)
                if not isinstance(node, dict):
                    continue
                here = {k: node.get(k, above.get(k)) for k in ("Resources", "MediaBox")}
                kids = self.get(node.get("Kids"))
                if isinstance(kids, list):
                    todo += [(k, here) for k in reversed(kids)]
                else:
                    out.append(node | {k: v for k, v in here.items() if v is not None})
        if not out:
            for n in sorted({*self.places, *self.known}):
                node = self.get(Ref(n)) if n in self.places else self.known[n]
                if isinstance(node, dict) and node.get("Type") == Name("Page"):
                    out.append(node)
        return out[:MOST_PAGES]

    def info(self) -> dict[str, str]:
        got = self.get(self.trailer.get("Info"))
        return {k: plain_text(v) for k in ("Title", "Author", "Subject", "Keywords") if isinstance(got, dict) and isinstance(v := self.get(got.get(k)), bytes)}


def inflated(data: bytes) -> bytes:
    """As much as can be inflated."""
    for wbits in (15, -15):
        d, out = zlib.decompressobj(wbits), b""
        try:
            out = d.decompress(data, MOST_STREAM)
        except zlib.error:
            d, parts = zlib.decompressobj(wbits), []
            try:
                for at in range(0, len(data), 256):
                    parts.append(d.decompress(data[at : at + 256], MOST_STREAM))
            except zlib.error:
                pass
            out = b"".join(parts)
        if out:
            return out
    return b""


def predicted(data: bytes, parms: dict) -> bytes:
    """The rows that a PNG predictor stands for."""
    if not isinstance(parms.get("Predictor"), int) or parms["Predictor"] < 10:
        return data
    size = max(1, parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) // 8)
    width = max(1, (parms.get("Columns", 1) * parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) + 7) // 8)
    out, before = bytearray(), bytearray(width)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width].ljust(width, b"\0"))
        for i in range(width):
            left, up, corner = (row[i - size] if i >= size else 0), before[i], (before[i - size] if i >= size else 0)
            if kind == 4:
                p = left + up - corner
                add = min((left, up, corner), key=lambda v: abs(p - v))
            else:
                add = {1: left, 2: up, 3: (left + up) // 2}.get(kind, 0)
            row[i] = (row[i] + add) & 255
        out += row
        before = row
    return bytes(out)


def ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~")[0]:
        if c == 122 and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                value = 0
                for g in group:
                    value = value * 85 + g
                out += (value & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        value = 0
        for g in group + [84] * (5 - len(group)):
            value = value * 85 + g
        out += (value & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def run_lengths(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128 and len(out) < MOST_STREAM:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def plain_text(raw: bytes) -> str:
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("cp1252", "replace")


@dataclass
class Font:
    """How a font's codes become text: a map by code, the bytes of a code, and the code page where the map has none."""

    by: dict = field(default_factory=dict)
    width: int = 1
    mac: bool = False

    def text(self, raw: bytes) -> str:
        if not self.by:
            return "" if self.width == 2 else raw.decode("mac_roman" if self.mac else "cp1252", "replace")
        out = []
        for at in range(0, len(raw), self.width):
            code = int.from_bytes(raw[at : at + self.width], "big")
            out.append(self.by.get(code, "" if self.width == 2 else bytes([code]).decode("cp1252", "replace")))
        return "".join(out)


def unicode_map(data: bytes) -> tuple[dict[int, str], int]:
    """Codes and their texts of a ToUnicode map, and the bytes of a code."""
    lex, values, by, width = Lexer(data, 0, False), [], {}, 1
    while (v := lex.value()) is not None or lex.at < len(data):
        if not isinstance(v, Word):
            values.append(v)
            continue
        if v.value == b"endcodespacerange":
            width = max((len(x) for x in values if isinstance(x, bytes)), default=1)
        elif v.value == b"endbfchar":
            for a, b in zip(values[::2], values[1::2]):
                if isinstance(a, bytes) and isinstance(b, bytes):
                    by[int.from_bytes(a, "big")] = b.decode("utf-16-be", "replace")
        elif v.value == b"endbfrange":
            for a, b, to in zip(values[::3], values[1::3], values[2::3]):
                if not isinstance(a, bytes) or not isinstance(b, bytes):
                    continue
                lo, hi = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                for k in range(min(hi - lo + 1, 65_536)):
                    if isinstance(to, list):
                        if k < len(to) and isinstance(to[k], bytes):
                            by[lo + k] = to[k].decode("utf-16-be", "replace")
                    elif isinstance(to, bytes) and to:
                        last = int.from_bytes(to, "big") + k
                        by[lo + k] = last.to_bytes(max(len(to), (last.bit_length() + 7) // 8), "big").decode("utf-16-be", "replace")
        elif v.value in (b"begincodespacerange", b"beginbfchar", b"beginbfrange"):
            pass
        values = []
    return by, min(width, 2)


class Page:
    """Runs the content of a page: its text in the order that it is shown, and the area of its images."""

    def __init__(self, pdf: Pdf, page: dict):
        self.pdf, self.fonts = pdf, {}
        self.parts: list[str] = []
        self.area = 0.0
        self.last: tuple[float, float] | None = None
        box = [pdf.get(x) for x in pdf.get(page.get("MediaBox")) or []]
        ok = len(box) == 4 and all(isinstance(x, (int, float)) for x in box)
        self.size = abs((box[2] - box[0]) * (box[3] - box[1])) if ok else 612.0 * 792.0
        content = pdf.get(page.get("Contents"))
        streams = [pdf.get(x) for x in content] if isinstance(content, list) else [content]
        data = b"\n".join(pdf.content(s) for s in streams if isinstance(s, Stream))
        self.run(data, pdf.get(page.get("Resources")) or {}, 0)

    def font(self, resources: dict, name: str) -> Font:
        fonts = self.pdf.get(resources.get("Font")) or {}
        ref = fonts.get(name) if isinstance(fonts, dict) else None
        key = ref if isinstance(ref, Ref) else name
        if key not in self.fonts:
            f, out = self.pdf.get(ref), Font()
            if isinstance(f, dict):
                out.width = 2 if f.get("Subtype") == Name("Type0") else 1
                out.mac = self.pdf.get(f.get("Encoding")) == Name("MacRomanEncoding")
                to = self.pdf.get(f.get("ToUnicode"))
                if isinstance(to, Stream):
                    by, width = unicode_map(self.pdf.content(to))
                    out.by, out.width = by, 2 if out.width == 2 else width
            self.fonts[key] = out
        return self.fonts[key]

    def show(self, text: str) -> None:
        if text:
            self.parts.append(text)

    def gap(self, kind: str) -> None:
        if self.parts and not self.parts[-1].endswith(("\n", kind)):
            self.parts.append(kind)

    def run(self, data: bytes, resources: dict, depth: int) -> None:
        lex, stack, font = Lexer(data, 0, False), [], Font()
        scale, saved = 1.0, []
        while lex.at < len(data):
            v = lex.value()
            if not isinstance(v, Word):
                stack.append(v)
                if len(stack) > 4096:
                    stack = stack[-64:]
                continue
            op = v.value
            numbers = [x for x in stack if isinstance(x, (int, float)) and not isinstance(x, bool)]
            if op == b"Tf" and stack and isinstance(stack[0], Name):
                font = self.font(resources, stack[0].value)
            elif op == b"Tj" and stack and isinstance(stack[-1], bytes):
                self.show(font.text(stack[-1]))
            elif op in (b"'", b'"') and stack and isinstance(stack[-1], bytes):
                self.gap("\n")
                self.show(font.text(stack[-1]))
            elif op == b"TJ" and stack and isinstance(stack[-1], list):
                for x in stack[-1]:
                    if isinstance(x, bytes):
                        self.show(font.text(x))
                    elif isinstance(x, (int, float)) and x < -180:
                        self.gap(" ")
            elif op in (b"Td", b"TD") and len(numbers) >= 2:
                self.gap("\n" if abs(numbers[1]) > 0.5 else " ")
            elif op == b"T*":
                self.gap("\n")
            elif op == b"Tm" and len(numbers) >= 6:
                here = (numbers[4], numbers[5])
                if self.last is not None:
                    self.gap("\n" if abs(here[1] - self.last[1]) > 0.5 else " ")
                self.last = here
            elif op == b"ET":
                self.gap("\n")
            elif op == b"q":
                saved.append(scale)
            elif op == b"Q":
                scale = saved.pop() if saved else 1.0
            elif op == b"cm" and len(numbers) >= 6:
                scale *= abs(numbers[0] * numbers[3] - numbers[1] * numbers[2])
            elif op == b"Do" and stack and isinstance(stack[-1], Name):
                forms = self.pdf.get(resources.get("XObject")) or {}
                x = self.pdf.get(forms.get(stack[-1].value)) if isinstance(forms, dict) else None
                if isinstance(x, Stream):
                    if x.head.get("Subtype") == Name("Image"):
                        self.area += scale
                    elif x.head.get("Subtype") == Name("Form") and depth < 8:
                        self.run(self.pdf.content(x), self.pdf.get(x.head.get("Resources")) or resources, depth + 1)
            elif op == b"BI":
                self.area += scale
                end = re.compile(rb"\sEI(?=\s|$)").search(data, lex.at)
                lex.at = end.end() if end else len(data)
            stack = []

    def text(self) -> str:
        return "".join(self.parts)


def pdf(data: bytes, sink: Sink, depth: int = 0) -> None:
    """Pages with an anchor each. A file of which some page is a scan is marked as one that needs recognition."""
    start = data.find(b"%PDF-", 0, 1024)
    if start < 0:
        raise ReadError("no PDF")
    file = Pdf(data)
    for k, v in file.info().items():
        setattr(sink.meta, k.lower(), v.strip())
    pages = file.pages()
    if not pages:
        raise ReadError("no pages")
    sink.pages = len(pages)
    for n, page in enumerate(pages, 1):
        shown = Page(file, page)
        text = shown.text()
        if sum(c.isalnum() for c in text) < SCAN_LETTERS and shown.area >= SCAN_SHARE * shown.size:
            sink.needs_ocr = True
        sink.line()
        sink.anchor("Page", n)
        sink.write(text)
        sink.line()
