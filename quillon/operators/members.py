"""Members of containers: the messages of a mail archive as documents of their own, their paths, and a container's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Extensions of containers; what stands before a member's number in its path, and the largest number. Fixed values.
CONTAINERS, MARK, MOST = ("pst",), "#", 2**32 - 1
#: The name of a message without a subject. Fixed value.
NO_SUBJECT = "(no subject)"
_GAPS = " \t\n\x0b\x0c\r"


def member_name(subject: Column) -> Column:
    name = F.btrim(subject, F.lit(_GAPS))
    return F.when(name != "", name).otherwise(NO_SUBJECT)


def member_docs(messages: DataFrame) -> DataFrame:
    """One document for each row of ``messages`` (path, container, folder, subject, sender, text, sent, mtime).

    A message is named by its subject, lies in a folder that is its container, and is dated when it was sent; without that,
    as its container (mtime). ``shown_dir`` is for people, ``meta`` is searched beside the text. Null and empty subjects,
    senders and folders count as absent; rows are neither merged nor dropped.
    """
    name, sender, folder = member_name(F.col("subject")), F.nullif("sender", F.lit("")), F.nullif("folder", F.lit(""))
    return messages.select(
        "path",
        "container",
        name.alias("name"),
        F.concat("container", F.lit("/")).alias("dir"),
        F.concat_ws(" › ", "container", folder).alias("shown_dir"),
        F.lit("eml").alias("ext"),
        F.lit("text").alias("kind"),
        F.octet_length("text").cast("long").alias("size"),
        F.coalesce("sent", "mtime").alias("mtime"),
        F.col("text").alias("content"),
        F.concat_ws("\n", name, sender, folder).alias("meta"),
        F.struct(name.alias("title"), sender.alias("author"), folder.alias("folder")).alias("info"),
    )


def container_summary(messages: DataFrame, by: str = "container") -> DataFrame:
    """(container, messages, skipped): how many members each container has, and how many of them have no text."""
    return messages.groupBy(by).agg(F.count("*").alias("messages"), F.count_if(F.coalesce(F.col("text"), F.lit("")) == "").alias("skipped"))


def is_container(path: Column) -> Column:
    """Whether a file of this name can have members."""
    return T.extension(F.substring_index(path, "/", -1)).isin(*CONTAINERS)


def member_path(container: Column, number: Column) -> Column:
    return F.concat(container, F.lit(f"/{MARK}"), number.cast("string"))


def split_member(path: Column) -> Column:
    """(container, number) of a member's path, null for any other path."""
    number = F.regexp_extract(path, rf"/{MARK}([0-9]+)\z", 1)
    container = F.regexp_extract(path, rf"^(?s)(.*)/{MARK}[0-9]+\z", 1)
    whole = number.try_cast("decimal(38,0)")
    return F.when((whole <= MOST) & is_container(container), F.struct(container.alias("container"), whole.cast("long").alias("number")))


def replace_members(files: DataFrame, fresh: DataFrame, containers: DataFrame) -> DataFrame:
    """``files`` in which the containers (path) that were read again have the members ``fresh``, and no others. A container
    that was read and has none loses those it had; rows of ``fresh`` that belong to no such container are left out."""
    read = containers.select(F.col("path").alias("__container")).distinct()
    of = lambda df: df.withColumn("__container", split_member(F.col("path"))["container"])
    kept = of(files).join(read, "__container", "left_anti")
    return kept.select(*files.columns).unionByName(of(fresh).join(read, "__container", "left_semi").select(*files.columns))
