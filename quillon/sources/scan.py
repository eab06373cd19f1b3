"""Scans of folders: which files there are, filtered by name, place, kind and size; sniffing; and routing to readers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.corpus import with_paths
from .compound import compound_kind
from .kinds import BINARY, EXCLUDED, MAGIC, SYSTEM, kind, kind_of

HEAD = 8192


@dataclass
class Filter:
    names: tuple = EXCLUDED
    globs: tuple = ()
    paths: tuple = ()
    hidden: bool = False
    system: bool = False
    only_exts: tuple = ()
    not_exts: tuple = ()
    most_bytes: int | None = None
    skip: tuple = field(default_factory=tuple)

    def column(self) -> Column:
        """True for files that a scan keeps, over path, name, ext and size."""
        out = F.lit(True)
        parts = F.split(F.lower("path"), "/")
        if self.names:
            out = out & ~F.arrays_overlap(parts, F.array(*[F.lit(n.lower()) for n in self.names]))
        if not self.hidden:
            out = out & ~F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
        if not self.system:
            out = out & ~F.element_at(parts, -1).isin(*SYSTEM)
        if self.globs:
            out = out & ~reduce(or_, [F.exists(parts, matching(T.glob_regex(g.lower()))) for g in self.globs])
        for p in (*self.paths, *self.skip):
            out = out & ~F.startswith("path", F.lit(p.rstrip("/") + "/"))
        if self.only_exts:
            out = out & F.col("ext").isin(*self.only_exts)
        if self.not_exts:
            out = out & ~F.col("ext").isin(*self.not_exts)
        return out if self.most_bytes is None else out & (F.col("size") <= self.most_bytes)


def scan(spark: SparkSession, root: str, keep: Filter | None = None) -> DataFrame:
    """(path, size, mtime in seconds, content, and the parts of the path) of the files under a folder. Content is read
    only by plans that use it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    df = with_paths(raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), "content"))
    return df.filter((keep or Filter()).column())


def matching(pattern: str):
    return lambda part: part.rlike(pattern)


def sniff(head: bytes) -> str:
    """The class of a file by its first 8 KB."""
    head = head[:HEAD]
    if head.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        return "compound"
    if head.startswith((b"PK\x03\x04", b"PK\x05\x06")):
        return "zip"
    if b"%PDF-" in head[:1024]:
        return "pdf"
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf16"
    if head.startswith(MAGIC):
        return "binary"
    if head.startswith(b"{\\rtf"):
        return "rtf"
    if len(head) >= 16:
        odd, even = head[1::2], head[::2]
        if odd.count(0) > 0.4 * len(odd) and even.count(0) < 0.05 * len(even) or even.count(0) > 0.4 * len(even) and odd.count(0) < 0.05 * len(odd):
            return "utf16"
    if 0 in head:
        return "binary"
    start = head.lstrip(b"\xef\xbb\xbf \t\r\n")[:512].lower()
    if start.startswith((b"<!doctype html", b"<html")) or b"<html" in start:
        return "html"
    if start.startswith(b"<?xml"):
        return "xml"
    control = sum(c < 32 and c not in (9, 10, 12, 13, 27) for c in head)
    return "binary" if control > 0.02 * len(head) else "text"


#: Readers by extension, and the signature that a reader needs. Fixed values.
BY_EXT = {
    "html": "html", "htm": "html", "xhtml": "html", "shtml": "html", "hta": "html", "xml": "xml", "json": "json", "rtf": "rtf", "docx": "docx", "docm": "docx", "dotx": "docx", "dotm": "docx",
    "pptx": "pptx", "pptm": "pptx", "potx": "pptx", "potm": "pptx", "ppsx": "pptx", "ppsm": "pptx", "xlsx": "xlsx", "xlsm": "xlsx", "xltx": "xlsx", "xltm": "xlsx", "xlam": "xlsx",
    "odt": "odf", "ott": "odf", "ods": "odf", "ots": "odf", "odp": "odf", "otp": "odf", "epub": "epub", "eml": "eml", "zip": "zip", "pdf": "pdf", "ai": "pdf",
    "doc": "doc", "dot": "doc", "xls": "xls", "xlt": "xls", "xla": "xls", "ppt": "ppt", "pps": "ppt", "pot": "ppt", "msg": "msg",
}
NEEDS = {"docx": "zip", "pptx": "zip", "xlsx": "zip", "odf": "zip", "epub": "zip", "zip": "zip", "rtf": "rtf", "pdf": "pdf", "doc": "compound", "xls": "compound", "ppt": "compound", "msg": "compound"}


def route(ext: str, signature: str, detect: bool = True, data: bytes | None = None) -> str | None:
    """The reader for a file: its extension's if the signature allows it, else by signature; None for names only.

    ``data``: the whole file, by which a compound file's kind is told."""
    reader = BY_EXT.get(ext)
    if reader and (NEEDS.get(reader, signature) == signature or reader in NEEDS and signature == "text") and (reader in NEEDS or signature not in ("binary", "compound")):
        return "encrypted" if signature == "compound" and data is not None and compound_kind(data) == "encrypted" else reader
    if reader is None and ext in BINARY:
        return None
    if signature == "compound":
        found = compound_kind(data) if data is not None else None
        return found or (reader if reader in NEEDS else None)
    if reader in NEEDS and signature in ("binary", "zip"):
        return reader  # damaged: the reader reports it
    if signature in ("text", "utf16"):
        return "plain" if detect or kind_of(ext) != "other" else None
    return {"html": "html", "xml": "xml", "rtf": "rtf", "zip": "zip", "pdf": "pdf"}.get(signature) if detect else None


def sniff_udf():
    @F.pandas_udf("string")
    def run(heads: pd.Series) -> pd.Series:
        return heads.map(lambda h: sniff(bytes(h or b"")))

    return run


def simple(path: str) -> str:
    """A path without . and doubled slashes."""
    return re.sub(r"/(\./)+|/{2,}", "/", T.filter_form(path))
