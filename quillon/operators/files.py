"""The file catalog: comparing a listing with a snapshot, renames, statuses, counters, and applying changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Smallest file that is paired as renamed.
RENAME_BYTES = 64 * 1024
#: Values of a status, and bits of the flags. Fixed values.
STATUS = {0: "indexed", 1: "name_only", 2: "failed", 3: "encrypted", 4: "needs_ocr", 5: "too_large", 6: "ignored"}
PROBLEMS = (2, 3, 4, 5)
FLAGS = {"truncated": 1, "needs_ocr": 2, "ocr": 4, "name_only": 8, "encrypted": 16, "failed": 32, "approx_pages": 64}


def diff(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, action, size, mtime, old_size, old_mtime) for every path of either side; action is new, changed, deleted or
    same. Size and time together tell a change; paths are unique on each side."""
    old = snapshot.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("__old"))
    new = listing.select("path", "size", "mtime", F.lit(True).alias("__new"))
    action = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "deleted").when(F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime")), "same").otherwise("changed")
    return new.join(old, "path", "full_outer").withColumn("action", action).drop("__old", "__new")


def rename_pairs(changes: DataFrame, least: int = RENAME_BYTES) -> DataFrame:
    """(from_path, to_path, size, mtime): deleted and new files of one size and time, paired one to one in path order."""
    w = Window.partitionBy("size", "mtime").orderBy("path")
    gone = changes.filter((F.col("action") == "deleted") & (F.col("old_size") >= least)).select("path", F.col("old_size").alias("size"), F.col("old_mtime").alias("mtime"))
    came = changes.filter((F.col("action") == "new") & (F.col("size") >= least)).select("path", "size", "mtime")
    a = gone.withColumn("rank", F.row_number().over(w)).withColumnRenamed("path", "from_path")
    b = came.withColumn("rank", F.row_number().over(w)).withColumnRenamed("path", "to_path")
    return a.join(b, ["size", "mtime", "rank"]).select("from_path", "to_path", "size", "mtime")


def guarded_deletes(changes: DataFrame, failed_dirs: DataFrame) -> DataFrame:
    """Deleted paths that lie under no folder (column dir) that could not be read. Every ancestor of a path is looked up
    by equality, so no pair of a path and a folder is compared for nothing."""
    parts = F.split("path", "/")
    gone = changes.filter(F.col("action") == "deleted").select("path")
    above = gone.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir"))
    kept = above.join(failed_dirs.select(F.rtrim(F.col("dir"), F.lit("/")).alias("dir")).distinct(), "dir", "left_semi").select("path").distinct()
    return gone.join(kept, "path", "left_anti")


def scan_requests(asked: DataFrame) -> DataFrame:
    """(root, dir) once each; a request for a whole root (dir is null) takes the place of those for its folders."""
    whole = asked.filter("dir IS NULL").select("root").distinct()
    parts = asked.filter("dir IS NOT NULL").select("root", "dir").distinct().join(whole, "root", "left_anti")
    return whole.withColumn("dir", F.lit(None).cast(asked.schema["dir"].dataType)).unionByName(parts)


def scan_summary(listing: DataFrame, failed_dirs: DataFrame) -> DataFrame:
    """One row (dirs, files, bytes, errors) for a listing (path, size) and the folders that could not be read (dir); dirs
    are those that hold a file."""
    seen = listing.groupBy(F.expr("left(path, length(path) - length(substring_index(path, '/', -1)))").alias("dir")).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    found = seen.agg(F.count("*").alias("dirs"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("b"), F.lit(0)).cast("long").alias("bytes"))
    errors = failed_dirs.select("dir").distinct().agg(F.count("*").alias("errors"))
    return found.withColumn("__k", F.lit(1)).join(errors.withColumn("__k", F.lit(1)), "__k").drop("__k")


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("n"))


def root_counts(files: DataFrame) -> DataFrame:
    return files.filter("status <> 6").groupBy("root").agg(F.count("*").alias("n"))


def root_info(roots: DataFrame, files: DataFrame) -> DataFrame:
    """(root, path, files, bytes, problems, last_mtime) of every root (root, path), also of one without files. Ignored files
    do not count; a null size counts as none. Files are summed before they meet the roots."""
    seen = files.filter("status <> 6").groupBy("root").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("status").isin(*PROBLEMS)).alias("problems"), F.max("mtime").alias("last_mtime")
    )
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return roots.select("root", "path").join(seen, "root", "left").select("root", "path", none("files"), none("bytes"), none("problems"), "last_mtime")


def percentiles(rows: DataFrame, value: str, by: tuple = (), shares: tuple = (0.5, 0.95, 0.99)) -> DataFrame:
    """n, mean, p50, p95 and p99 (for the default ``shares``) of a numeric column, for each group of ``by``.

    A percentile is interpolated between the two values about it; nulls do not count and a group of nulls only has none.
    Equal values are counted first, by group and value, so that a hot group is spread; what is then merged for a group are
    its distinct values with their counts.
    """
    keys = list(by)
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    found = counted.groupBy(*keys).agg(
        F.sum("__n").alias("n"), (F.sum(F.col("__v") * F.col("__n")) / F.sum("__n")).alias("mean"), F.percentile("__v", F.array(*map(F.lit, shares)), F.col("__n")).alias("__p")
    )
    return found.select(*keys, "n", "mean", *[F.col("__p")[k].alias(f"p{s * 100:g}".replace(".", "_")) for k, s in enumerate(shares)])


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(F.col("status") != 6).alias("files"), F.count_if(F.col("status") == 4).alias("pending_ocr"), F.sum(F.when(F.col("status") != 6, F.col("size"))).alias("bytes"))


def problems(files: DataFrame, status: int | None = None, contains: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """Files with a problem by path; ``contains`` is looked for in either case, without wildcards."""
    rows = files.filter(F.col("status").isin(*PROBLEMS) if status is None else F.col("status") == status)
    if text := contains.replace("%", "").replace("_", ""):
        rows = rows.filter(F.contains(F.lower("path"), F.lit(text.lower())))
    return rows.orderBy("path").offset(offset).limit(min(limit, 1000))


def pending_ocr(files: DataFrame, limit: int = 100) -> DataFrame:
    return files.filter("status = 4").orderBy("size", "path").limit(limit)


def hot_dirs(opens: DataFrame, limit: int = 200) -> DataFrame:
    """Folders by how often files in them were opened, the latest first among equals."""
    return opens.groupBy("dir").agg(F.count("*").alias("hits"), F.max("ts").alias("last_at")).orderBy(F.desc("hits"), F.desc("last_at"), "dir").limit(limit)


def flag_names(flags: Column) -> Column:
    return F.filter(F.array(*[F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in FLAGS.items()]), lambda x: x.isNotNull())


def members_of(files: DataFrame, container: str) -> DataFrame:
    return files.filter(F.col("container") == container)


def upsert(snapshot: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """The snapshot with the changed rows in place of those with their key. Of several rows for a key one stays."""
    fresh = changed.dropDuplicates([key])
    return snapshot.join(fresh.select(key), key, "left_anti").select(*snapshot.columns).unionByName(fresh.select(*snapshot.columns))


def remove(snapshot: DataFrame, path: str | None = None, folder: str | None = None, root: int | None = None, container: str | None = None) -> DataFrame:
    """The snapshot without one path, all under a folder, a root's rows or a container's members."""
    out = snapshot
    if path is not None:
        out = out.filter(F.col("path") != path)
    if folder is not None:
        out = out.filter(~F.startswith("path", F.lit(folder.rstrip("/") + "/")))
    if root is not None:
        out = out.filter(F.col("root") != root)
    if container is not None:
        out = out.filter(F.coalesce(F.col("container") != container, F.lit(True)))
    return out


def touch(snapshot: DataFrame, seen: DataFrame) -> DataFrame:
    """Sizes and times from ``seen`` (path, size, mtime); everything else stays."""
    s = seen.select("path", F.col("size").alias("__size"), F.col("mtime").alias("__mtime"))
    return snapshot.join(s, "path", "left").withColumn("size", F.coalesce("__size", "size")).withColumn("mtime", F.coalesce("__mtime", "mtime")).select(*snapshot.columns)


def recheck(files: DataFrame, condition: Column) -> DataFrame:
    """Rows that the next scan must read again: their time is no time."""
    return files.withColumn("mtime", F.when(condition, F.lit(-1)).otherwise(F.col("mtime")))
