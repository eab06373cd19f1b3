"""Hard negatives by a matrix product in blocks of two dimensions, with the tiles of the product at rest.

Rows lie in blocks, in the order of their labels, and vectors in chunks of dimensions. A task keeps the panels of a group of
anchors and has the panels of a share of the rows come by, one after the other, from the shared folder. The products of
their chunks are added to the tile where it is, and of each tile only what is among an anchor's best so far is kept. So
neither tiles nor the panels of rows are shuffled: what is written is the panels once, the anchors once for each share, and
the best of each anchor and share.

The product runs twice, over tiles that share hardly a pair: first those in which an anchor meets rows of its own label,
for the positives, then those with other labels, where the positives' scores give the windows of the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import shared_dir, stored, table
from .files import place
from .ranks import ranked

#: Anchors and rows of a tile, dimensions of a chunk.
ANCHORS, ROWS, DIMS = 256, 1024, 32
#: Blocks of anchors that a task keeps, and tasks for each core.
RESIDENT, TASKS = 16, 4
#: Scaled components beyond this are set to it, so that scores and their multiples stay within 64 bits (up to 1,024 dimensions).
LARGEST = 1 << 24
LOW = np.iinfo(np.int64).min
WINDOWS = "array<struct<line: int, place: int, id: bigint, score: bigint>>"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: float) -> DataFrame:
    """(id, label, v): scaled whole-number vectors of the rows that take part."""
    v = F.col(vector_col)
    x = F.transform(v, lambda c: F.least(F.greatest(F.floor(F.lit(float(scale)) * c.cast("double")), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("v"), good.alias("good"))
    return rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND good").select("id", "label", "v")


PANEL = "block bigint, ids binary, labels binary, data array<binary>"
#: Row groups of few panels, which are what shares of the rows are made of.
GROUPS = {"parquet.block.size.row.check.min": 1, "parquet.block.row.count.limit": 8}


def blocks(rows: DataFrame, size: int, dims: int, width: int, where: str) -> DataFrame:
    """Rows (id, label, v), each once, in numbered blocks of ``size``: their panels (block, ids, labels, data), in ``where``/panels."""
    placed = ranked(rows.distinct().withColumn("all", F.lit(0)), "all", ["label", "id", "v"], f"{where}/order").withColumn("block", F.floor(F.col("rank") / size))
    dealt = placed.select("block", "rank", "id", "label", "v").repartition("block").sortWithinPartitions("block", "rank")
    return stored(dealt.mapInArrow(paneled(size, dims, width), PANEL), f"{where}/panels", 1 << 20, GROUPS)


def write_rows(rows: DataFrame, size: int, dims: int, width: int, where: str) -> None:
    """Panels of the rows (id, label, v), each once, under ``where``. Equal rows meet in one range of the order, so vectors are
    shuffled once; blocks end with their range and have no numbers of their own."""
    dealt = rows.repartitionByRange("label", "id", "v").sortWithinPartitions("label", "id", "v").withColumn("block", F.lit(0).cast("long"))
    stored(dealt.mapInArrow(paneled(size, dims, width), PANEL), where, 1 << 20, GROUPS)


def paneled(size: int, dims: int, width: int):
    """Sorted rows as panels. Data of a panel are one binary for each chunk: 32-bit numbers, a row of ``width`` of them for each
    vector, zero where it ends."""
    chunks = max(1, -(-dims // width))

    def panels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, labels, vectors in grouped(batches, size):
            full = np.zeros((len(ids), chunks * width), np.int32)
            for i, v in enumerate(vectors):
                full[i, : len(v)] = v
            data = [np.ascontiguousarray(full[:, k * width : (k + 1) * width]).tobytes() for k in range(chunks)]
            one = lambda x: pa.array([x.tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([block]), one(ids), one(labels), pa.array([data], pa.list_(pa.binary()))], names=["block", "ids", "labels", "data"])

    return panels


def grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Consecutive rows of one block, ``size`` at most, without those that equal the row before: (block, ids, labels, vectors)."""
    block, ids, labels, vectors, last = None, [], [], [], None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("block", "id", "label")]
        v, flat = batch.column("v"), batch.column("v").flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        for n, (b, i, y) in enumerate(zip(*columns)):
            x = flat[ends[n] : ends[n + 1]]
            if last is not None and last[:2] == (i, y) and np.array_equal(last[2], x):
                continue
            last = (i, y, x)
            if ids and (b != block or len(ids) == size):
                yield block, np.array(ids, np.int64), np.array(labels, np.int64), vectors
                ids, labels, vectors = [], [], []
            block = b
            ids.append(i), labels.append(y), vectors.append(x)
    if ids:
        yield block, np.array(ids, np.int64), np.array(labels, np.int64), vectors


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole-number product of two panels; in floating point where every sum is below 2 ** 53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def narrow(tile: np.ndarray) -> bytes:
    """A tile in 32 bits where all its scores fit, else in 64; its length tells which."""
    return tile.astype(np.int32 if not tile.size or max(-int(tile.min()), int(tile.max())) < 1 << 31 else np.int64).tobytes()


class Panel:
    """A panel in memory: ids, labels and chunks of vectors, with the smallest and the largest label."""

    def __init__(self, ids: bytes, labels: bytes, data: list[bytes], width: int):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.lo, self.hi = int(self.labels.min()), int(self.labels.max())
        self.chunks = [np.frombuffer(d, np.int32).reshape(len(self.ids), width) for d in data]
        self.floats = [c.astype(np.float64) for c in self.chunks]
        self.reach = max(int(np.abs(c).max(initial=0)) for c in self.chunks)

    def alike(self, lo: int, hi: int) -> bool:
        """Whether rows with labels from ``lo`` to ``hi`` may have one of the panel's."""
        return lo <= self.hi and self.lo <= hi

    def unlike(self, lo: int, hi: int) -> bool:
        """Whether rows with labels from ``lo`` to ``hi`` may have another than one of the panel's."""
        return not lo == hi == self.lo == self.hi

    def tile(self, other: Panel) -> np.ndarray:
        shape = (len(self.ids), len(other.ids))
        if self.reach * other.reach * sum(c.shape[1] for c in self.chunks) < 1 << 53:  # exact in floating point
            return sum((a @ b.T for a, b in zip(self.floats, other.floats)), np.zeros(shape)).astype(np.int64)
        return sum(map(product, self.chunks, other.chunks), np.zeros(shape, np.int64))


def passing(where: str, share: int, shares: int, width: int, wanted) -> Iterator[Panel]:
    """The panels of a share of the row groups under ``where`` whose smallest and largest label are ``wanted``."""
    system, path = place(where)
    at = -1
    for f in sorted(i.path for i in system.get_file_info(fs.FileSelector(path)) if i.path.endswith(".parquet")):
        with system.open_input_file(f) as source:
            file = pq.ParquetFile(source)
            for g in range(file.num_row_groups):
                at += 1
                if at % shares != share:
                    continue
                labels = [np.frombuffer(x, np.int64) for x in file.read_row_group(g, ["labels"]).column(0).to_pylist()]
                if not any(wanted(int(y.min()), int(y.max())) for y in labels):
                    continue
                for batch in file.iter_batches(1, [g], ["ids", "labels", "data"]):
                    row = batch.to_pylist()[0]
                    panel = Panel(row["ids"], row["labels"], row["data"], width)
                    if wanted(panel.lo, panel.hi):
                        yield panel


def met(anchors: DataFrame, rows: str, count: int, width: int, which: str, pick, out: str, resident: int = RESIDENT) -> DataFrame:
    """What ``pick`` keeps of the tiles of each anchor panel and the row panels under ``rows`` that are ``which`` (alike or
    unlike), for each share of the rows. ``count``: blocks of anchors. ``pick(panel, windows)`` gives an object with add(rows,
    tile) and rows().

    Anchors are dealt by (group of ``resident`` blocks, share). With more groups there are fewer shares, so copies of anchors and
    candidates grow with the anchors alone."""
    groups = -(-count // resident)
    shares = max(1, -(-TASKS * anchors.sparkSession.sparkContext.defaultParallelism // groups))
    dealt = anchors.withColumn("g", F.floor(F.col("a") / resident)).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dealt = dealt.select("g", "share", "a", "ids", "labels", "data", "windows").repartition(groups * shares, "g", "share").sortWithinPartitions("g", "share", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, kept in cells(batches):
            panels = [(r["a"], Panel(r["ids"], r["labels"], r["data"], width)) for r in kept]
            picks = [pick(p, r["windows"] or ()) for (_, p), r in zip(panels, kept)]
            for row in passing(rows, share, shares, width, lambda lo, hi: any(getattr(p, which)(lo, hi) for _, p in panels)):
                for (_, p), mine in zip(panels, picks):
                    if getattr(p, which)(row.lo, row.hi):
                        mine.add(row, p.tile(row))
            for (a, _), mine in zip(panels, picks):
                made = mine.rows()
                yield pa.RecordBatch.from_pydict({"a": np.full(len(made["id"]), a, np.int64), **made})

    return dealt.mapInArrow(run, out)


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The anchor panels of each group and share, which stand together."""
    key, kept = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if kept and (row["g"], row["share"]) != key:
                yield key[1], kept
                kept = []
            key = (row["g"], row["share"])
            kept.append(row)
    if kept:
        yield key[1], kept


def best(score: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the ``k`` best allowed scores of each line, ties by the smaller id."""
    if score.shape[1] > k:
        masked = np.where(allowed, score, LOW)
        allowed = allowed & (score >= np.partition(masked, -k, axis=1)[:, -k][:, None])
    line, col = np.nonzero(allowed)
    order = np.lexsort((ids[col], -score[line, col], line))
    line, col = line[order], col[order]
    place = np.arange(len(line)) - np.searchsorted(line, line)
    return line[place < k], col[place < k]


class Best:
    """The ``count`` best entries of each line over all tiles so far, ties by the smaller id."""

    def __init__(self, lines: int, count: int):
        self.count, self.floor = count, np.full(lines, LOW)
        self.line, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, score: np.ndarray, allowed: np.ndarray) -> None:
        """Adds the allowed entries of a tile; those below ``floor`` may be left out before."""
        line, col = np.nonzero(allowed)
        if not len(line):
            return
        if len(line) > 8 * self.count * len(score):
            line, col = best(score, ids, allowed, self.count)
        line, found, s = (np.concatenate(x) for x in ((self.line, line), (self.id, ids[col]), (self.score, score[line, col])))
        order = np.lexsort((found, -s, line))
        line, found, s = line[order], found[order], s[order]
        place = np.arange(len(line)) - np.searchsorted(line, line)
        self.line, self.id, self.score = (x[place < self.count] for x in (line, found, s))
        last = place == self.count - 1
        self.floor[line[last]] = s[last]


class SameLabel:
    """Candidates for the positives: the best rows of the anchor's label that have another id."""

    def __init__(self, panel: Panel, windows, count: int):
        self.panel, self.best = panel, Best(len(panel.ids), count)

    def add(self, rows: Panel, tile: np.ndarray) -> None:
        mask = (tile >= self.best.floor[:, None]) & (self.panel.labels[:, None] == rows.labels)
        self.best.add(rows.ids, tile, mask & (self.panel.ids[:, None] != rows.ids))

    def rows(self) -> dict:
        return {"line": self.best.line.astype(np.int32), "id": self.best.id, "score": self.best.score}


class InWindows:
    """Candidates for the negatives of each positive: the best rows of other labels whose score lies between two shares of its own."""

    def __init__(self, panel: Panel, windows, count: int, low: tuple[int, int], high: tuple[int, int]):
        self.panel, self.windows = panel, []
        for place in sorted({w["place"] for w in windows}):
            mine = [w for w in windows if w["place"] == place]
            wanted = np.array([w["score"] for w in mine], np.int64)[:, None]
            # the least and the largest whole numbers that satisfy the conditions
            self.windows.append((place, np.array([w["line"] for w in mine]), -(-low[0] * wanted // low[1]), high[0] * wanted // high[1], Best(len(mine), count)))

    def add(self, rows: Panel, tile: np.ndarray) -> None:
        other = self.panel.labels[:, None] != rows.labels if self.panel.alike(rows.lo, rows.hi) else None
        for _, lines, least, most, kept in self.windows:
            every = len(lines) == len(tile) and (lines[1:] > lines[:-1]).all()  # no copy of the tile
            s = tile if every else tile[lines]
            mask = (s >= np.maximum(least, kept.floor[:, None])) & (s <= most)
            if other is not None:
                mask &= other if every else other[lines]
            kept.add(rows.ids, s, mask)

    def rows(self) -> dict:
        none = np.zeros(0, np.int64)
        parts = [(lines[k.line], np.full(len(k.line), place), k.id, k.score) for place, lines, _, _, k in self.windows]
        line, place, found, s = (np.concatenate(x) for x in zip(*parts)) if parts else (none,) * 4
        return {"line": line.astype(np.int32), "place": place.astype(np.int32), "id": found, "score": s}


def hard_negatives(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: float = 256, positives: int = 5, negatives: int = 3,
    low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20), anchor_rows: int = ANCHORS, block_rows: int = ROWS, width: int = DIMS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row for which ``anchors`` (a
    condition on ``id``) holds and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of
    other labels with low * positive_score <= negative_score <= high * positive_score (shares in whole numbers).

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Components are multiplied by
    ``scale`` and rounded down; beyond 2 ** 24 they are set to that. Scores are exact up to 1,024 dimensions; a shorter
    vector ends in zeros. Equal rows count once; rows of one id that differ are rows of their own, but no partners of each
    other as positives. Ties go by the smaller id. Anchors without positives or negatives, and an empty table, give no rows. Other
    columns are not read.
    """
    spark, where = df.sparkSession, shared_dir(df.sparkSession)
    rows = whole_vectors(df, id_col, vector_col, F.col("label") if label is None else label, scale)
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    write_rows(rows, block_rows, dims, width, f"{where}/rows")
    a_panels = blocks(rows.filter(anchors), anchor_rows, dims, width, f"{where}/anchors").withColumnRenamed("block", "a")
    count = (a_panels.agg(F.max("a")).first()[0] or 0) + 1  # blocks of anchors

    panels = a_panels.withColumn("windows", F.lit(None).cast(WINDOWS))
    found = met(panels, f"{where}/rows", count, width, "alike", partial(SameLabel, count=positives), "a bigint, line int, id bigint, score bigint")
    mine = stored(first_of(found, ["a", "line"], "place", positives), f"{where}/positives")
    windows = mine.groupBy("a").agg(F.collect_list(F.struct("line", "place", "id", "score")).alias("windows"))  # anchor_rows * positives at most
    found = met(a_panels.join(windows, "a"), f"{where}/rows", count, width, "unlike", partial(InWindows, count=negatives, low=low, high=high), "a bigint, line int, place int, id bigint, score bigint")
    theirs = first_of(found, ["a", "line", "place"], "rank", negatives).select("a", "line", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = a_panels.select("a", "ids").mapInArrow(spelled, "a bigint, line int, anchor_id bigint")
    return (
        theirs.join(mine.select("a", "line", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["a", "line", "place"]).join(names, ["a", "line"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def first_of(found: DataFrame, keys: list[str], name: str, k: int) -> DataFrame:
    """The ``k`` best candidates of each key, numbered from 1; Spark keeps only ``k`` of each before the shuffle as well."""
    return found.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).filter(F.col(name) <= k)


def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, ids in zip(batch.column("a").to_pylist(), batch.column("ids").to_pylist()):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), a)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["a", "line", "anchor_id"])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


SQL = """
WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.id)::INT AS rank, s.id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.id) <= 3
"""
