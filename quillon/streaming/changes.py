"""Change streams: quiet periods, rename pairing, storms, folding in the order of time, and applying batches to a snapshot.

A change is a row (root, path, op, ts) that may have size and mtime of the file, a cookie that joins the halves of a rename,
from_path of a whole rename, and seq, which orders changes of one ts. Each step hands on what it got.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.files import diff, guarded_deletes, rename_pairs
from ..operators.store import Store
from ..session import shared_folder

QUIET, STORM = "600 milliseconds", 20_000


HALVES = ("rename_from", "rename_to")
CARRIED = {"size": "long", "mtime": "long", "cookie": "string", "from_path": "string", "seq": "long"}


def whole(changes: DataFrame) -> DataFrame:
    """The changes with all columns that a change may have, null where they have none."""
    for c, kind in {"root": "long", "ts": "timestamp", **CARRIED}.items():
        if c not in changes.columns:
            changes = changes.withColumn(c, F.lit(None).cast(kind))
    return changes


def debounce(changes: DataFrame, quiet: str = QUIET, late: str = "10 seconds") -> DataFrame:
    """One row for each path and burst, once the path was quiet: the last operation with all that belongs to it, how many
    there were (n) and when they began (start). Of several at one ts that with the largest seq counts, then the last by its
    values. Halves of renames and whole renames are none of a burst and pass. Works on streams and tables."""
    changes = whole(changes)
    if changes.isStreaming:
        changes = changes.withWatermark("ts", late)
    moves = F.col("op").isin(*HALVES, "rename")
    last = F.max(F.struct("ts", F.coalesce("seq", F.lit(0)).alias("order"), "op", "size", "mtime", "cookie", "from_path", "seq"))
    bursts = changes.filter(~moves).groupBy("root", "path", F.session_window("ts", quiet).alias("w")).agg(last.alias("x"), F.count("*").alias("n"))
    names = ["size", "mtime", "cookie", "from_path", "seq"]
    calm = bursts.select("root", "path", "x.op", "n", F.col("w.start").alias("start"), F.col("x.ts").alias("last_ts"), "x.ts", *[f"x.{c}" for c in names])
    passing = changes.filter(moves).select("root", "path", "op", F.lit(1).cast("long").alias("n"), F.col("ts").alias("start"), F.col("ts").alias("last_ts"), "ts", *names)
    return calm.unionByName(passing)


def sessions(changes: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Bursts of a key in a table, by gaps: (key, start, end, n). A gap of ``gap_seconds`` or more begins a new one."""
    w = Window.partitionBy(key).orderBy("ts")
    new = F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) < gap_seconds * 1_000_000, 0).otherwise(1)
    marked = changes.select(key, "ts").withColumn("__new", new).withColumn("__s", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "__s").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n")).drop("__s")


def storms(changes: DataFrame, window: str = "10 seconds", most: int = STORM) -> DataFrame:
    """(root, window start, paths) of the windows in which a root had more changed paths than are followed one by one."""
    if changes.isStreaming:
        changes = changes.withWatermark("ts", window)
    n = F.approx_count_distinct("path") if changes.isStreaming else F.countDistinct("path")
    return changes.groupBy("root", F.window("ts", window).alias("w")).agg(n.alias("paths")).filter(F.col("paths") > most).select("root", F.col("w.start").alias("start"), "paths")


def supersede(changes: DataFrame, storms_: DataFrame) -> DataFrame:
    """Changes with those of stormy roots replaced by one rescan of the root."""
    roots = storms_.select("root").distinct()
    calm = changes.join(roots, "root", "left_anti")
    return calm.unionByName(roots.select("root", F.lit("/").alias("path"), F.lit("rescan").alias("op")), allowMissingColumns=True)


def pair_renames(changes: DataFrame, wait_ms: int = 600) -> DataFrame:
    """A stream of (root, path, op, ts, cookie): rename_from and rename_to with one cookie become a rename; what finds no
    partner within ``wait_ms`` of processing time becomes a remove or an upsert. Other operations pass.

    Each cookie of a root has a state and a deadline of its own, so traffic on a root keeps no half waiting. Spark runs batches
    without data for such deadlines, also under the trigger availableNow, which therefore does not end by itself."""
    changes = whole(changes)
    names = ["root", "op", "path", "from_path", "ts", "seq", "size", "mtime"]
    schema = "root long, op string, path string, from_path string, ts timestamp, seq long, size long, mtime long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        root, out = key[0], []
        waiting = tuple(state.get) if state.exists else None

        def alone(half: tuple) -> tuple:
            return (root, "remove" if half[0] == HALVES[0] else "upsert", half[1], None, *half[2:])

        if state.hasTimedOut:
            out.append(alone(waiting))
            waiting = None
        else:
            rows = pd.concat(list(frames))
            for r in rows.sort_values(["ts", "seq", "op"]).itertuples():
                now = (r.op, r.path, r.ts.to_pydatetime(), *(None if pd.isna(x) else int(x) for x in (r.seq, r.size, r.mtime)))
                if waiting is not None and waiting[0] != r.op:
                    a, b = (waiting, now) if r.op == HALVES[1] else (now, waiting)
                    out.append((root, "rename", b[1], a[1], max(a[2], b[2]), *b[3:]))  # size and time are those of the new name
                    waiting = None
                else:
                    if waiting is not None:
                        out.append(alone(waiting))
                    waiting = now
        if waiting is not None:
            if not state.exists or tuple(state.get) != waiting:
                state.update(waiting)
                state.setTimeoutDuration(wait_ms)
        elif state.exists:
            state.remove()
        made = pd.DataFrame(out, columns=names)
        yield made.astype({"seq": "Int64", "size": "Int64", "mtime": "Int64"}).assign(ts=pd.to_datetime(made["ts"]))

    named = F.col("op").isin(*HALVES)
    passing = changes.filter(~named).select(*names)
    paired = changes.filter(named).groupBy("root", "cookie").applyInPandasWithState(step, schema, "op string, path string, ts timestamp, seq long, size long, mtime long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return passing.unionByName(paired)


def fold(changes: DataFrame) -> DataFrame:
    """What a batch of changes comes to, one row for each path that it touches: (path, op, from_path, size, mtime, ts).

    Operations count in the order of ts, then seq, then their values; equal rows count once. op is ``remove`` where nothing is
    left, ``move`` where the file is one that stood under from_path before the batch, and else ``upsert``. A chain of renames
    ends at its last name: each rename points at what last filled its from_path, and pointers are doubled until all have
    arrived, so a chain of n renames takes log n rounds. Sizes and times are the last ones that were told along the chain.
    """
    spark = changes.sparkSession
    rows = whole(changes).filter(F.col("op").isin("upsert", "remove", "rename")).filter("NOT (op = 'rename' AND from_path <=> path)")
    at = F.struct("ts", F.coalesce("seq", F.lit(0)).alias("seq"), "op", "path", "from_path", "size", "mtime")
    # an upsert fills a path, a remove empties it; a rename empties one and fills another
    ends = F.when(F.col("op") == "rename", F.array(F.struct(F.col("from_path").alias("on"), F.lit(False).alias("full")), F.struct(F.col("path").alias("on"), F.lit(True).alias("full"))))
    ends = ends.otherwise(F.array(F.struct(F.col("path").alias("on"), (F.col("op") == "upsert").alias("full"))))
    touched = rows.select(at.alias("at")).distinct().select("at", "at.*").select("at", "op", "size", "mtime", "ts", F.explode(ends).alias("e")).select("at", "op", "size", "mtime", "ts", "e.on", "e.full")
    before = F.lag(F.struct("at", "full")).over(Window.partitionBy("on").orderBy("at"))
    touched = _cut(touched.withColumn("before", before), spark)
    came = touched.filter("full").select("at", "op", "size", "mtime")
    source = touched.filter("op = 'rename' AND NOT full").select("at", F.col("on").alias("origin"), "before")
    nodes = came.join(source, "at", "left").select(
        "at", "size", "mtime",
        F.when(F.col("op") == "rename", F.when(F.col("before.full"), F.col("before.at"))).alias("next"),
        F.when((F.col("op") == "rename") & F.col("before").isNull(), F.col("origin")).alias("origin"),
    )
    nodes = _cut(nodes, spark)
    while not nodes.filter("next IS NOT NULL").isEmpty():
        there = nodes.select(F.col("at").alias("next"), F.col("next").alias("n2"), F.col("origin").alias("o2"), F.col("size").alias("s2"), F.col("mtime").alias("m2"))
        nodes = nodes.join(there, "next", "left").select("at", F.coalesce("size", "s2").alias("size"), F.coalesce("mtime", "m2").alias("mtime"), F.col("n2").alias("next"), F.coalesce("origin", "o2").alias("origin"))
        nodes = _cut(nodes, spark)
    last = touched.groupBy(F.col("on").alias("path")).agg(F.max(F.struct("at", "full", "ts")).alias("x")).select("path", "x.at", "x.full", "x.ts")
    found = last.join(nodes.withColumn("at_", F.col("at")).drop("at"), (F.col("at") == F.col("at_")) & F.col("full"), "left")
    op = F.when(~F.col("full"), "remove").when(F.col("origin").isNotNull(), "move").otherwise("upsert")
    return found.select("path", op.alias("op"), F.col("origin").alias("from_path"), "size", "mtime", "ts")


def _cut(df: DataFrame, spark) -> DataFrame:
    """``df`` written in the shared folder and read again, so that a loop's plan doesn't grow and lost executors cost nothing."""
    where = shared_folder(spark, "fold")
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """A snapshot of files after changes (upsert, remove and rename, see ``fold``). A file that moves keeps what was known of
    it, but for a size or time that came with the change. A move whose file is not there, as in a replay, leaves its new name
    as it is; where that is not there either, it counts as an upsert if it brings a size. Other columns of an upsert come
    from the changes where they have them."""
    net = fold(changes)
    others = [c for c in files.columns if c not in ("path", "size", "mtime")]
    extra = [c for c in others if c in changes.columns and c not in ("root", "ts", "seq", "cookie", "from_path")]
    if extra:  # what the last upsert of a path says in other columns
        told = whole(changes).filter("op = 'upsert'").groupBy("path").agg(F.max_by(F.struct(*extra), F.struct("ts", F.coalesce("seq", F.lit(0)), "size", "mtime")).alias("told"))
        net = net.join(told, "path", "left")
    was = files.select(F.col("path").alias("from_path"), *[F.col(c).alias(f"was_{c}") for c in files.columns if c != "path"], F.lit(True).alias("known"))
    here = files.select("path", F.lit(True).alias("here"))
    net = net.join(was, "from_path", "left").join(here, "path", "left")
    moves = (F.col("op") == "move") & F.col("known").isNotNull()
    stays = (F.col("op") == "move") & F.col("known").isNull() & F.col("here").isNotNull()
    fresh = (F.col("op") == "upsert") | (F.col("op") == "move") & F.col("known").isNull() & F.col("here").isNull() & F.col("size").isNotNull()
    made = {}
    for c in files.columns:
        kind = files.schema[c].dataType
        own = F.col(c) if c in ("path", "size", "mtime") else F.col("told")[c] if c in extra else F.lit(None)
        made[c] = own.cast(kind) if c == "path" else F.when(moves, F.coalesce(own, F.col(f"was_{c}")) if c in ("size", "mtime") else F.col(f"was_{c}")).otherwise(own).cast(kind)
    came = net.filter(moves | fresh).select(*[made[c].alias(c) for c in files.columns])
    rest = files.join(net.filter(~stays).select("path"), "path", "left_anti").select(*files.columns)
    return rest.unionByName(came)


def lost_changes(files: DataFrame, listing: DataFrame, failed_dirs: DataFrame | None = None) -> DataFrame:
    """The changes (path, op, from_path, size, mtime) that lead from a snapshot to what a listing (path, size, mtime) shows:
    what a change source lost. Nothing under ``failed_dirs`` (dir) is taken as removed. Large files of one size and time that
    went and came are renames."""
    found = diff(listing.select("path", "size", "mtime"), files.select("path", "size", "mtime"))
    gone = found.filter("action = 'deleted'").select("path")
    if failed_dirs is not None:
        gone = guarded_deletes(found, failed_dirs)
    sure = found.join(gone, "path", "left_semi").unionByName(found.filter("action = 'new'"))
    moved = rename_pairs(sure)
    none = F.lit(None)
    return (
        moved.select(F.col("to_path").alias("path"), F.lit("rename").alias("op"), "from_path", "size", "mtime")
        .unionByName(found.filter("action IN ('new', 'changed')").join(moved.select(F.col("to_path").alias("path")), "path", "left_anti").select("path", F.lit("upsert").alias("op"), none.cast("string").alias("from_path"), "size", "mtime"))
        .unionByName(gone.join(moved.select(F.col("from_path").alias("path")), "path", "left_anti").select("path", F.lit("remove").alias("op"), none.cast("string").alias("from_path"), none.cast("long").alias("size"), none.cast("long").alias("mtime")))
    )


def reconcile(store: Store, listing: DataFrame, failed_dirs: DataFrame | None = None) -> int:
    """Repairs the store's table ``files`` by a full listing; returns the generation. Without a difference there is no new one."""
    files = store.table("files")
    if files is None:
        return store.commit(files=listing.select("path", "size", "mtime"))
    lost = _cut(lost_changes(files, listing, failed_dirs), files.sparkSession)
    return store.manifest()["generation"] if lost.isEmpty() else store.commit(files=apply_changes(files, lost))


def into_store(store: Store):
    """A foreachBatch function that applies each batch to the store's table ``files``, once. The batch is written first, so
    that a stream with state is run once for all that is asked of it; an empty one makes no generation."""

    return lambda batch, number: _apply(store, _cut(batch, batch.sparkSession), number)


def _apply(store: Store, changes: DataFrame, number: int) -> None:
    files = store.table("files")
    if files is None:  # the first changes make the table
        names = [c for c in changes.columns if c not in ("op", "from_path", "root", "ts", "seq", "cookie", "n", "start", "last_ts")]
        files = changes.select(*names).limit(0)
        store.commit(number, files=apply_changes(files, changes))
    elif not changes.isEmpty():
        store.commit(number, files=apply_changes(files, changes))


@dataclass
class Policy:
    """When what waits is committed: as soon as it has so many rows or bytes, or its first batch is so many seconds old."""

    rows: int = 1_000_000
    bytes: int = 256 << 20
    seconds: float = 30.0


class Gathering:
    """A foreachBatch function that commits several batches as one generation, by a policy.

    Each batch is written to the folder ``where``, which driver and executors share, before its trigger ends, so a stream that
    was stopped loses none: those that the store has not seen are found there again, a batch that is replayed is written
    over, and one that the store has seen is passed over. What waits is folded together, by ts and seq. ``finish`` commits
    what is left when a stream has ended. The table ``files`` is read and written once for a commit, not for a batch.
    """

    def __init__(self, store: Store, where: str, policy: Policy | None = None):
        self.store, self.where, self.policy = store, where.rstrip("/"), policy or Policy()

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.store.manifest()["batch"]:
            return
        fs, at = self.store.fs, f"{self.where}/batch-{number}"
        fs.delete(self.store.path(f"{at}.done"), False)
        batch.write.mode("overwrite").parquet(at)
        fs.create(self.store.path(f"{at}.done"), True).close()
        if self.due():
            self.finish()

    def _written(self) -> list[int]:
        fs, folder = self.store.fs, self.store.path(self.where)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(x[6:-5]) for x in names if re.fullmatch(r"batch-\d+\.done", x))

    def waiting(self) -> list[int]:
        """Numbers of the batches that are written whole and not committed, in order."""
        seen = self.store.manifest()["batch"]
        return [n for n in self._written() if n > seen]

    def _read(self, numbers: list[int]) -> DataFrame:
        return self.store.spark.read.parquet(*[f"{self.where}/batch-{n}" for n in numbers])

    def due(self) -> bool:
        numbers, p = self.waiting(), self.policy
        if not numbers:
            return False
        first = self.store.fs.getFileStatus(self.store.path(f"{self.where}/batch-{numbers[0]}.done")).getModificationTime()
        if time.time() - first / 1000 >= p.seconds or sum(self.store.bytes(f"{self.where}/batch-{n}") for n in numbers) >= p.bytes:
            return True
        return self._read(numbers).count() >= p.rows  # from the footers

    def finish(self) -> int:
        """Commits what waits; how many batches that was."""
        numbers = self.waiting()
        if numbers:
            changes = self._read(numbers)
            if changes.isEmpty() and self.store.table("files") is not None:
                self.store.commit(numbers[-1])
            else:
                _apply(self.store, changes, numbers[-1])
        seen = self.store.manifest()["batch"]
        for n in self._written():  # also what a run that was stopped has left
            if n <= seen:
                self.store.fs.delete(self.store.path(f"{self.where}/batch-{n}"), True)
                self.store.fs.delete(self.store.path(f"{self.where}/batch-{n}.done"), False)
        return len(numbers)


def classify(changed: DataFrame, listing: DataFrame) -> DataFrame:
    """(root, path, op) for each changed path (root, path), by what is there now (path, kind): a file is an upsert, a folder
    a scan_dir, nothing a remove. Anything else, such as a device, gives no row. The listing's paths are unique."""
    now = listing.select("path", F.col("kind").alias("__kind"), F.lit(True).alias("__there"))
    op = F.when(F.col("__there").isNull(), "remove").when(F.col("__kind") == "file", "upsert").when(F.col("__kind") == "dir", "scan_dir")
    return changed.select("root", "path").distinct().join(now, "path", "left").select("root", "path", op.alias("op")).filter("op IS NOT NULL")
