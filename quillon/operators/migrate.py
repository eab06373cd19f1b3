"""Stores of older versions: read as they are, and taken over without reading every file again.

Each version that a store may have is known by readers, one for a table, which give it in the present form. A migration
decides for every document of the old store, by two left joins (catalog, stored texts), whether it is made anew from what
is stored or its file must be read again; nothing but the joins' narrow rows is shuffled before that is known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import FLAGS, STATUS, recheck

#: Statuses whose documents have content.
WITH_TEXT = tuple(code for code, name in STATUS.items() if name in ("indexed", "needs_ocr"))

READERS: dict[tuple[int, str], Callable[[DataFrame], DataFrame]] = {}


def reader(version: int, table: str):
    """Registers a function that gives a table of an older version in the form of the next one."""

    def add(f: Callable[[DataFrame], DataFrame]):
        READERS[version, table] = f
        return f

    return add


def read_as(df: DataFrame, table: str, version: int, to: int) -> DataFrame:
    """A table of one version in the form of a later one: the readers of each version between them, in turn. Where a
    version has no reader for the table, its form did not change."""
    for v in range(version, to):
        df = READERS.get((v, table), lambda x: x)(df)
    return df


@reader(1, "documents")
def documents_of_version_1(df: DataFrame) -> DataFrame:
    """Version 1 had no flags, titles, properties and anchors; a column that is there already stays."""
    added = {"flags": F.lit(0).cast("long"), "title": F.lit(None).cast("string"), "meta": F.lit(""), "status": F.lit(0)}
    for name, value in added.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df


def verdict(members: Column) -> Column:
    """What becomes of a document that the catalog knows; the first that holds.

    ``read``: a container, whose members are found only by reading it; a text that is not stored; one that was cut, unless
    it was recognised from an image, which costs more than what was cut off. ``rebuild``: all others, those without
    content from their properties alone.
    """
    flags = F.coalesce(F.col("flags"), F.lit(0).cast("long"))
    has = lambda name: flags.bitwiseAND(F.lit(FLAGS[name])) != 0
    cut = F.coalesce(F.col("__cut"), F.lit(False)) | has("truncated")
    return (
        F.when(members, "container").when(~F.coalesce(F.col("status").isin(*WITH_TEXT), F.lit(False)), "no_content")
        .when(F.col("__stored").isNull(), "not_stored").when(cut & ~has("ocr"), "cut").otherwise("stored")
    )


def plan(old: DataFrame, catalog: DataFrame, texts: DataFrame, container: Column | None = None) -> DataFrame:
    """(path, action, reason, size, mtime, flags, status) of each document of ``old`` (path) that the ``catalog`` (path,
    size, mtime, flags, status) still has. ``texts`` (path, cut) are those that are stored; of repeated paths of either the
    outcome is one row, a text that was cut once counts as cut. ``container`` is a condition on the columns of the catalog.

    action is ``rebuild`` or ``read``; documents that the catalog does not have give no row, and the next scan does not expect
    them either. Null paths give none.
    """
    known = catalog.select("path", "size", "mtime", "flags", "status", (F.lit(False) if container is None else F.coalesce(container, F.lit(False))).alias("__box"))
    known = known.filter("path IS NOT NULL").dropDuplicates(["path"])
    stored = texts.groupBy("path").agg(F.max("cut").alias("__cut"), F.lit(True).alias("__stored"))
    joined = old.select("path").distinct().join(known, "path").join(stored, "path", "left")
    reason = verdict(F.col("__box"))
    return joined.select("path", F.when(reason.isin("stored", "no_content"), "rebuild").otherwise("read").alias("action"), reason.alias("reason"), "size", "mtime", "flags", "status")


def rebuilt(old: DataFrame, planned: DataFrame, texts: DataFrame) -> DataFrame:
    """The documents of ``old`` that are made anew, in its columns: size, mtime, flags and status from the catalog, content
    from the stored texts (path, content), null for those without content."""
    kept = planned.filter("action = 'rebuild'").select("path", "reason", *[F.col(c).alias(f"__{c}") for c in ("size", "mtime", "flags", "status")])
    known = [c for c in ("size", "mtime", "flags", "status") if c in old.columns]
    base = old.drop("content", *known).join(kept, "path")
    body = texts.select("path", "content").filter("path IS NOT NULL").dropDuplicates(["path"])
    return base.join(body, "path", "left").select(*[F.col(f"__{c}").cast(old.schema[c].dataType).alias(c) if c in known else F.when(F.col("reason") == "stored", F.col("content")).alias(c) if c == "content" else F.col(c) for c in old.columns])


def to_read(catalog: DataFrame, planned: DataFrame) -> DataFrame:
    """The catalog in which files that must be read again have no time, so that the next scan takes them as changed."""
    again = planned.filter("action = 'read'").select("path", F.lit(True).alias("__again"))
    marked = catalog.join(again, "path", "left")
    return recheck(marked, F.coalesce(F.col("__again"), F.lit(False))).select(*catalog.columns)
