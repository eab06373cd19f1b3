"""Compound files: the container of the older office formats, its kinds, and the texts of DOC, XLS, PPT and MSG files.

Offsets and record numbers are those of the formats' public specifications.
"""

from __future__ import annotations

import re
import struct

from .sink import ReadError, Sink

END, FREE = 0xFFFFFFFE, 0xFFFFFFFF
#: Sectors of a file and characters of a stream that are followed at most, so that loops and lies end.
MOST_SECTORS, MOST_STREAM = 1 << 20, 256 << 20


class Compound:
    """The streams of a compound file by path; ``/`` separates storages."""

    def __init__(self, data: bytes):
        if len(data) < 512 or not data.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
            raise ReadError("no compound file")
        self.data = data
        shift, small = struct.unpack_from("<HH", data, 30)
        if not 7 <= shift <= 16 or not 2 <= small <= shift:
            raise ReadError("sector sizes are out of range")
        self.size, self.small = 1 << shift, 1 << small
        first_dir, = struct.unpack_from("<I", data, 48)
        self.cutoff, first_mini, _, next_table, tables = struct.unpack_from("<5I", data, 56)
        places = list(struct.unpack_from("<109I", data, 76))
        for _ in range(min(tables, MOST_SECTORS)):
            if next_table >= END - 2:
                break
            block = self._ints(self._sector(next_table))
            places += block[:-1]
            next_table = block[-1]
        self.table: list[int] = []
        for p in places:
            if p < END - 2:
                self.table += self._ints(self._sector(p))
        entries = self._chain(first_dir)
        self.entries = [self._entry(entries[at : at + 128]) for at in range(0, len(entries) - 127, 128)]
        if not self.entries:
            raise ReadError("no directory")
        self.mini_table = self._ints(self._chain(first_mini)) if first_mini < END else []
        self.mini = self._chain(self.entries[0][5])[: self.entries[0][6]]
        self.streams: dict[str, tuple[int, int]] = {}
        self.storages: list[str] = []
        self._walk(self.entries[0][4], "", set())

    def _ints(self, block: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(block) // 4}I", block[: len(block) // 4 * 4]))

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size]

    def _chain(self, n: int) -> bytes:
        out, seen = [], 0
        while n < len(self.table) and seen < MOST_SECTORS:
            out.append(self._sector(n))
            n, seen = self.table[n], seen + 1
        return b"".join(out)

    @staticmethod
    def _entry(e: bytes) -> tuple:
        n = struct.unpack_from("<H", e, 64)[0]
        name = e[: max(0, min(n, 64) - 2)].decode("utf-16-le", "replace")
        left, right, child = struct.unpack_from("<3I", e, 68)
        return name, e[66], left, right, child, *struct.unpack_from("<IQ", e, 116)

    def _walk(self, root: int, folder: str, seen: set) -> None:
        todo = [(root, folder)]
        while todo:
            n, at = todo.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            name, kind, left, right, child, first, size = self.entries[n]
            todo += [(left, at), (right, at)]
            path = f"{at}{name}"
            if kind == 1:
                self.storages.append(path)
                todo.append((child, f"{path}/"))
            elif kind == 2:
                self.streams[path] = (first, size & 0xFFFFFFFF if self.size == 512 else size)

    def read(self, path: str) -> bytes | None:
        if path not in self.streams:
            return None
        first, size = self.streams[path]
        if size > MOST_STREAM:
            raise ReadError("a stream is too large")
        if size >= self.cutoff:
            return self._chain(first)[:size]
        out, seen = [], 0
        while first < len(self.mini_table) and seen < MOST_SECTORS:
            out.append(self.mini[first * self.small : (first + 1) * self.small])
            first, seen = self.mini_table[first], seen + 1
        return b"".join(out)[:size]


def compound_kind(data: bytes) -> str | None:
    """What a compound file holds: encrypted, doc, xls, ppt, msg; None for anything else."""
    try:
        streams = Compound(data).streams
    except (ReadError, struct.error):
        return None
    if "EncryptionInfo" in streams and "EncryptedPackage" in streams:
        return "encrypted"
    if "WordDocument" in streams:
        return "doc"
    if "Workbook" in streams or "Book" in streams:
        return "xls"
    if "PowerPoint Document" in streams:
        return "ppt"
    return "msg" if "__properties_version1.0" in streams else None


def properties(c: Compound, sink: Sink) -> None:
    """Title, subject, author and keywords of the summary stream."""
    data = c.read("\x05SummaryInformation")
    if not data or len(data) < 48:
        return
    try:
        base = struct.unpack_from("<I", data, 44)[0]
        n = min(struct.unpack_from("<I", data, base + 4)[0], 64)
        found = dict(struct.unpack_from("<II", data, base + 8 + 8 * k) for k in range(n))
        page = struct.unpack_from("<H", data, base + found[1] + 4)[0] if 1 in found else 1252
        for key, name in {2: "title", 3: "subject", 4: "author", 5: "keywords"}.items():
            if key in found:
                kind, size = struct.unpack_from("<II", data, base + found[key])
                raw = data[base + found[key] + 8 : base + found[key] + 8 + (size * 2 if kind == 31 else size)]
                text = raw.decode("utf-16-le" if kind == 31 else "utf-8" if page == 65001 else f"cp{page}", "replace")
                setattr(sink.meta, name, text.split("\0")[0].strip())
    except (struct.error, LookupError):
        return


#: The parts of a word document behind its body, in their order, by the place of their length in the header. Fixed values.
WORD_PARTS = ("Footnotes", "Headers", "Macros", "Comments", "Endnotes", "Text boxes", "Header text boxes")


def doc(data: bytes, sink: Sink, depth: int = 0) -> None:
    """Word 97-2003: the pieces of the text in order; field codes are left out, parts behind the body are sections."""
    c = Compound(data)
    properties(c, sink)
    body = c.read("WordDocument") or b""
    if len(body) < 0x1AA or struct.unpack_from("<H", body)[0] != 0xA5EC:
        raise ReadError("no word header")
    flags = struct.unpack_from("<H", body, 10)[0]
    if flags & 0x100:
        raise ReadError("encrypted", "encrypted")
    table = c.read("1Table" if flags & 0x200 else "0Table") or b""
    lengths = struct.unpack_from("<8i", body, 0x4C)
    at, size = struct.unpack_from("<II", body, 0x1A2)
    pieces, clx, i = None, table[at : at + size], 0
    while i < len(clx):
        if clx[i] == 1:
            i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
        elif clx[i] == 2:
            pieces = clx[i + 5 : i + 5 + struct.unpack_from("<I", clx, i + 1)[0]]
            break
        else:
            break
    if not pieces:
        raise ReadError("no piece table")
    n = (len(pieces) - 4) // 12
    places = struct.unpack_from(f"<{n + 1}I", pieces)
    out = []
    for k in range(n):
        where = struct.unpack_from("<I", pieces, 4 * (n + 1) + 8 * k + 2)[0]
        chars = max(0, places[k + 1] - places[k])
        if where & 0x40000000:
            start = (where & 0x3FFFFFFF) // 2
            out.append(body[start : start + chars].decode("cp1252", "replace"))
        else:
            out.append(body[where : where + 2 * chars].decode("utf-16-le", "replace"))
    text, start = "".join(out), 0
    for name, length in zip(("", *WORD_PARTS), lengths):
        part = word_text(text[start : start + max(0, length)])
        start += max(0, length)
        if part.strip() and name != "Macros":
            if name:
                sink.line()
                sink.anchor("Section", 0, name)
            sink.write(part)


def word_text(raw: str) -> str:
    """Marks of paragraphs, cells and lines as white space; of a field only its result stays."""
    out, inside = [], []
    for c in raw:
        if c == "\x13":
            inside.append(True)
        elif c == "\x14" and inside:
            inside[-1] = False
        elif c == "\x15" and inside:
            inside.pop()
        elif not any(inside):
            out.append({"\r": "\n", "\x0b": "\n", "\x0c": "\n", "\x07": "\t", "\x1e": "-", "\x1f": "", "\xa0": " "}.get(c, c))
    return "".join(out)


def records(data: bytes, lo: int = 0, hi: int | None = None):
    """(version and instance, type, from, to) of the records of a slide show's stream."""
    hi = len(data) if hi is None else min(hi, len(data))
    while lo + 8 <= hi:
        head, kind, size = struct.unpack_from("<HHI", data, lo)
        yield head, kind, lo + 8, min(lo + 8 + size, hi)
        lo += 8 + size


def ppt(data: bytes, sink: Sink, depth: int = 0) -> None:
    """PowerPoint 97-2003: texts of the slides in their order, then those drawn in slides, then notes."""
    c = Compound(data)
    properties(c, sink)
    if "EncryptedSummary" in c.streams:
        raise ReadError("encrypted", "encrypted")
    body = c.read("PowerPoint Document") or b""
    lists: dict[int, list] = {}
    drawn: list[tuple[int, list[str]]] = []

    def texts(lo: int, hi: int, into: list, level: int = 0) -> None:
        for head, kind, a, b in records(body, lo, hi):
            if kind == 0x0FA0:
                into.append(body[a:b].decode("utf-16-le", "replace"))
            elif kind == 0x0FA8:
                into.append(body[a:b].decode("latin-1"))
            elif head & 15 == 15 and level < 32:
                texts(a, b, into, level + 1)

    for head, kind, a, b in records(body):
        if kind == 0x03E8:  # the document: its lists of slides and notes
            for h, k, x, y in records(body, a, b):
                if k == 0x0FF0:
                    rows: list = []
                    for _, kk, p, q in records(body, x, y):
                        if kk == 0x03F3:
                            rows.append([])
                        elif kk in (0x0FA0, 0x0FA8):
                            if not rows:
                                rows.append([])
                            rows[-1].append(body[p:q].decode("utf-16-le" if kk == 0x0FA0 else "latin-1", "replace"))
                    lists[h >> 4] = rows
        elif kind in (0x03EE, 0x03F0):
            found: list = []
            texts(a, b, found)
            drawn.append((kind, found))
    slides = [list(x) for x in lists.get(0, [])]
    for k, (_, found) in enumerate(d for d in drawn if d[0] == 0x03EE):
        while len(slides) <= k:
            slides.append([])
        slides[k] += [t for t in found if t not in slides[k]]
    if not slides and not drawn:
        slides = [[]]
        texts(0, len(body), slides[0])
    for n, found in enumerate(slides, 1):
        sink.line()
        sink.anchor("Slide", n, " ".join(found[0].split())[:80] if found else "")
        for t in found:
            sink.write(t.replace("\r", "\n").replace("\x0b", "\n") + "\n")
    notes = [t for kind, found in drawn if kind == 0x03F0 for t in found] + [t for x in lists.get(2, []) for t in x]
    for t in dict.fromkeys(notes):
        sink.write(t.replace("\r", "\n") + "\n")


class _Cells:
    """Bytes of records that may go on in CONTINUE records, of which strings begin anew with a byte of options."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def more(self) -> bool:
        while self.part < len(self.parts) and self.at >= len(self.parts[self.part]):
            self.part, self.at = self.part + 1, 0
        return self.part < len(self.parts)

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.more():
            got = self.parts[self.part][self.at : self.at + n - len(out)]
            self.at += len(got)
            out += got
        return out

    def string(self) -> str:
        chars, options = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if options & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if options & 4 else 0
        out, wide = [], options & 1
        while chars and self.more():
            left = (len(self.parts[self.part]) - self.at) // (2 if wide else 1)
            n = min(chars, max(left, 1))
            out.append(self.take(2 * n if wide else n).decode("utf-16-le" if wide else "latin-1", "replace"))
            chars -= n
            if chars and self.at >= len(self.parts[self.part]) and self.part + 1 < len(self.parts):
                self.part, self.at = self.part + 1, 0
                wide = self.take(1)[0] & 1
        self.take(4 * runs + extra)
        return "".join(out)


def number(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def rk(value: int) -> float:
    """The number in a compressed cell."""
    x = float(value >> 2 if value < 1 << 31 else (value >> 2) - (1 << 30)) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return x / 100 if value & 1 else x


def xls(data: bytes, sink: Sink, depth: int = 0) -> None:
    """Excel 97-2003: the sheets' cells row by row: strings, numbers, results of formulas, TRUE and FALSE."""
    from .readers import RowWriter

    c = Compound(data)
    properties(c, sink)
    body = c.read("Workbook") or c.read("Book") or b""
    found: list[tuple[int, int, bytes]] = []
    at = 0
    while at + 4 <= len(body):
        kind, size = struct.unpack_from("<HH", body, at)
        found.append((at, kind, body[at + 4 : at + 4 + size]))
        at += 4 + size
    if any(kind == 0x2F for _, kind, _ in found):
        raise ReadError("encrypted", "encrypted")
    strings: list[str] = []
    sheets: list[tuple[int, str]] = []
    for k, (_, kind, row) in enumerate(found):
        if kind == 0x85 and len(row) >= 8:
            where, chars, wide = struct.unpack_from("<I", row)[0], row[6], row[7] & 1
            sheets.append((where, row[8 : 8 + (2 * chars if wide else chars)].decode("utf-16-le" if wide else "latin-1", "replace")))
        elif kind == 0xFC:
            parts = [row[8:]]
            for _, more, x in found[k + 1 :]:
                if more != 0x3C:
                    break
                parts.append(x)
            cells, total = _Cells(parts), struct.unpack_from("<I", row, 4)[0]
            try:
                while cells.more() and len(strings) < total:
                    strings.append(cells.string())
            except struct.error:
                pass
    index = {a: k for k, (a, *_) in enumerate(found)}
    for n, (where, name) in enumerate(sheets, 1):
        rows: dict[int, list] = {}
        waiting = None
        for _, kind, x in found[index.get(where, len(found)) + 1 :]:
            if kind == 0x0A:
                break
            try:
                r, col = struct.unpack_from("<HH", x) if len(x) >= 4 else (0, 0)
                put = rows.setdefault(r, []) if kind in (0xFD, 0x203, 0x27E, 0xBD, 0x205, 0x204, 0x06) else None
                if kind == 0xFD:
                    put.append((col, strings[struct.unpack_from("<I", x, 6)[0]]))
                elif kind == 0x203:
                    put.append((col, number(struct.unpack_from("<d", x, 6)[0])))
                elif kind == 0x27E:
                    put.append((col, number(rk(struct.unpack_from("<I", x, 6)[0]))))
                elif kind == 0xBD:
                    for k in range((len(x) - 6) // 6):
                        put.append((col + k, number(rk(struct.unpack_from("<I", x, 6 + 6 * k)[0]))))
                elif kind == 0x205 and not x[7]:
                    put.append((col, "TRUE" if x[6] else "FALSE"))
                elif kind == 0x204:
                    put.append((col, _Cells([x[6:]]).string()))
                elif kind == 0x06:
                    if x[12:14] != b"\xff\xff":
                        put.append((col, number(struct.unpack_from("<d", x, 6)[0])))
                    elif x[6] == 0:
                        waiting = (put, col)
                    elif x[6] == 1:
                        put.append((col, "TRUE" if x[8] else "FALSE"))
                elif kind == 0x207 and waiting:
                    waiting[0].append((waiting[1], _Cells([x]).string()))
                    waiting = None
            except (struct.error, IndexError, ValueError, OverflowError):
                continue
        sink.line()
        sink.anchor("Sheet", n, name)
        writer = RowWriter(sink)
        for r in sorted(rows):
            writer.row(r, rows[r])


def unpacked_rtf(data: bytes) -> bytes:
    """Compressed rich text of a message: a window of 4,096 bytes that begins with a fixed text."""
    if len(data) < 16 or data[8:12] != b"LZFu":
        return data[16:] if data[8:12] == b"MELA" else b""
    # the window's first text is a fixed value of the format
    first = (
        b"{\\rtf1\\ansi\\mac\\deff0\\deftab720{\\fonttbl;}{\\f0\\fnil \\froman \\fswiss \\fmodern \\fscript \\fdecor MS Sans SerifSymbolArialTimes New RomanCourier{\\colortbl\\red0\\green0\\blue0\r\n\\par \\pard\\plain\\f0\\fs20\\b\\i\\u\\tab\\tx"
    )
    window, at = bytearray(first + bytes(4096 - len(first))), len(first)
    out, i = bytearray(), 16
    while i < len(data) and len(out) < 64 << 20:
        bits, i = data[i], i + 1
        for k in range(8):
            if i >= len(data):
                break
            if bits >> k & 1:
                if i + 1 >= len(data):
                    return bytes(out)
                pair, i = data[i] << 8 | data[i + 1], i + 2
                start, n = pair >> 4, (pair & 15) + 2
                if start == at:
                    return bytes(out)
                for j in range(n):
                    b = window[(start + j) % 4096]
                    out.append(b)
                    window[at] = b
                    at = (at + 1) % 4096
            else:
                out.append(data[i])
                window[at] = data[i]
                at, i = (at + 1) % 4096, i + 1
    return bytes(out)


def msg(data: bytes, sink: Sink, depth: int = 0) -> None:
    """An Outlook message: headers, body (plain, else HTML, else compressed rich text), and attachments as parts."""
    _message(Compound(data), "", sink, depth)


def _message(c: Compound, at: str, sink: Sink, depth: int) -> None:
    from .readers import NESTING, embedded, html, rtf

    def value(folder: str, tag: int) -> str:
        wide, narrow = c.read(f"{folder}__substg1.0_{tag:04X}001F"), c.read(f"{folder}__substg1.0_{tag:04X}001E")
        return (wide.decode("utf-16-le", "replace") if wide is not None else (narrow or b"").decode("cp1252", "replace")).rstrip("\0")

    subject, sender, address = value(at, 0x0037), value(at, 0x0C1A), value(at, 0x0C1F)
    if not depth:
        sink.meta.title, sink.meta.author = subject, sender or address
    who = f"{sender} <{address}>" if sender and address and sender != address else sender or address
    for name, text in (("Subject", subject), ("From", who), ("To", value(at, 0x0E04)), ("Cc", value(at, 0x0E03))):
        if text:
            sink.write(f"{name}: {text}\n")
    sink.write("\n")
    if body := value(at, 0x1000):
        sink.write(body)
    elif markup := c.read(f"{at}__substg1.0_10130102") or value(at, 0x1013).encode():
        inner = Sink(max(0, sink.most - sink.size))
        html(markup, inner)
        sink.write(inner.text())
    elif packed := c.read(f"{at}__substg1.0_10090102"):
        inner = Sink(max(0, sink.most - sink.size))
        rtf(unpacked_rtf(packed), inner)
        sink.write(inner.text())
    sink.line()
    depth_here = at.count("/")
    for s in sorted(s for s in c.storages if s.startswith(f"{at}__attach_version1.0_") and s.count("/") == depth_here):
        name = value(f"{s}/", 0x3707) or value(f"{s}/", 0x3704) or value(f"{s}/", 0x3001)
        if (inside := f"{s}/__substg1.0_3701000D") in c.storages and depth < NESTING:
            sink.line()
            sink.anchor("Part", 0, name or "message")
            _message(c, f"{inside}/", sink, depth + 1)
        elif (content := c.read(f"{s}/__substg1.0_37010102")) is not None:
            embedded(re.sub(r"[\r\n\0]", " ", name) or "attachment", content, sink, depth)


def encrypted(data: bytes, sink: Sink, depth: int = 0) -> None:
    raise ReadError("encrypted", "encrypted")
