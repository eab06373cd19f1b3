"""The bounded text that readers write into: caps, tidying, anchors, time."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from ..functions.excerpt import Anchor

MOST_CHARS, SECONDS = 16 * 1024 * 1024, 20.0
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufeff]")


class Stop(Exception):
    """The sink is full or out of time; what was written counts."""


class ReadError(Exception):
    """A file that cannot be read; ``status`` is failed or encrypted."""

    def __init__(self, message: str, status: str = "failed"):
        super().__init__(message)
        self.status = status


@dataclass
class Meta:
    title: str = ""
    author: str = ""
    subject: str = ""
    keywords: str = ""

    def text(self) -> str:
        return "\n".join(x for x in (self.title, self.author, self.subject, self.keywords) if x)


class Sink:
    """Control characters become spaces, line ends are \\n, over two empty lines shrink, and text stops at a cap."""

    def __init__(self, most: int = MOST_CHARS, seconds: float = SECONDS):
        self.parts: list[str] = []
        self.size, self.most, self.until = 0, most, time.monotonic() + seconds
        self.anchors: list[Anchor] = []
        self.meta = Meta()
        self.truncated = False
        self.breaks = 0
        self.cr = False
        self.pages: int | None = None
        self.needs_ocr = False

    def write(self, text: str) -> None:
        if not text:
            return
        if self.cr and text.startswith("\n"):
            text = text[1:]
        self.cr = text.endswith("\r")
        text = _CONTROL.sub(" ", text.replace("\r\n", "\n").replace("\r", "\n"))
        lead = len(text) - len(text.lstrip("\n"))
        text = "\n" * min(lead, max(0, 2 - self.breaks)) + re.sub(r"\n{3,}", "\n\n", text[lead:])
        if not text:
            return
        stripped = text.rstrip("\n")
        self.breaks = len(text) - len(stripped) if stripped else self.breaks + len(text)
        room = self.most - self.size
        if len(text) > room:
            self.parts.append(text[:room])
            self.size += room
            self.truncated = True
            raise Stop
        self.parts.append(text)
        self.size += len(text)
        if time.monotonic() > self.until:
            self.truncated = True
            raise Stop

    def line(self) -> None:
        if self.size and not self.breaks:
            self.write("\n")

    def anchor(self, kind: str, num: int = 0, label: str = "") -> None:
        self.anchors.append(Anchor(self.size, kind, num, label))

    def text(self) -> str:
        return "".join(self.parts)
