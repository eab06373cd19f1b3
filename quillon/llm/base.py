"""Shared plumbing of the corpus operators: table access, the shared folder, batched text maps."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship


#: Rows of a batch between Spark and Python: texts are long, so fewer than Spark's own 10,000.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1024")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. A session that has Spark's own batch size gets a smaller one; one that was set stays."""
    ship(spark)
    if spark.conf.get(*BATCH[:2]) == BATCH[1]:
        spark.conf.set(BATCH[0], BATCH[2])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only where that is unset and the session runs in one process (tests) a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "quillon-shared")
        os.makedirs(base, exist_ok=True)
        base = "file://" + base
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base) if base.startswith("/") and spark.sparkContext.master.startswith("local") else base
    return f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def stored(df: DataFrame, where: str | None = None, row_group: int | None = None, options: dict | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage and survives lost executors.

    ``row_group``: bytes of a row group, for tables of large values, of which Spark reads up to 4,096 rows of a row group at once.
    """
    spark = df.sparkSession
    where = where or shared_dir(spark)
    out = df.write.mode("overwrite").options(**(options or {}))
    (out.option("parquet.block.size", row_group) if row_group else out).parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose tables nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives freed memory of a Python worker back, which lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def held_fold(id_col: str, folds: int, fold: int):
    """True where crc32(id as text) mod ``folds`` is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def unused(name: str, taken) -> str:
    """``name``, with underscores before it until no column in ``taken`` has it (whatever its case)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_texts(df: DataFrame, fn: Callable[[list], dict], schema: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """``fn`` applied to batches of whole texts (UTF-8 bytes, null as empty).

    fn: takes a list of bytes and returns {column: values}; ``schema`` names them. Only the id, the text and the columns
    in ``keep`` are read; the result has the id, ``keep`` and what ``fn`` returns. Batches are cut at about 8 MB. Two result
    columns of one name are an error here, before anything runs.
    """
    names, text = [id_col, *keep], unused("__text", [id_col, *keep])
    made = [f.name for f in T._parse_datatype_string(schema).fields]
    if len({c.lower() for c in (*names, *made)}) < len(names) + len(made):
        raise ValueError(f"columns of one name in {[*names, *made]}")
    src = df.select(*[F.col(c) for c in names], F.col(text_col).cast("binary").alias(text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                texts = [x or b"" for x in batch.column(text).to_pylist()]
                out = fn(texts)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + list(map(as_array, out.values())), names=names + list(out))
        trim()

    return src.mapInArrow(run, f"{fields}, {schema}")


def append_texts(df: DataFrame, fn: Callable[[list], dict], kinds: dict[str, str], text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``df`` with what ``fn`` makes of batches of whole texts, as in map_texts, behind them; and the names
    of the new columns, of which none is one of df's. ``kinds``: what fn gives, and its types."""
    names = df.columns
    new = {k: unused(f"__{k}", names) for k in kinds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                out = fn([(x or "").encode() for x in batch.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(as_array, out.values())], names=[*names, *(new[k] for k in out)])
        trim()

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{new[k]}` {v}" for k, v in kinds.items())])
    return df.mapInArrow(run, fields), new


def as_array(x) -> pa.Array:
    return x if isinstance(x, pa.Array) else pa.array(x)


def slices(batch: pa.RecordBatch, col: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose texts have about ``most`` bytes; a longer text is a part of its own."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)
