"""Tables cut into blocks: files of bounded numbers of rows in the shared folder, which tasks read again and again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import place

#: Rows of a block at most.
ROWS = 4096


class Blocks:
    """``df`` stored as blocks. ``files`` is a table (block, file), a row for each block."""

    def __init__(self, df: DataFrame, where: str, rows: int = ROWS):
        spark = df.sparkSession
        df.write.option("maxRecordsPerFile", rows).option("parquet.block.size", 8 << 20).option("compression", "zstd").parquet(where)
        self.names = sorted(spark.read.schema(df.schema).parquet(where).inputFiles())
        self.spark, self.schema = spark, df.schema
        self.files = spark.createDataFrame(list(enumerate(self.names)), "block int, file string")

    def __len__(self) -> int:
        return len(self.names)

    def spread(self) -> DataFrame:
        """The blocks, one in each task."""
        return self.files.repartition(max(1, len(self)))

    def with_rows(self, rows: DataFrame) -> DataFrame:
        """(block, file, payload): the rows (block, payload) that belong to each block and, for every block, one without."""
        return rows.select("block", F.lit(None).cast("string").alias("file"), "payload").unionByName(self.files.withColumn("payload", F.lit(None).cast("binary")))


def read_block(file: str, columns: list[str] | None = None, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    system, path = place(file.replace("%25", "%") if file.startswith("file:") else file)
    with system.open_input_file(path) as f:
        table = pq.ParquetFile(f)
        if not table.metadata.num_rows:  # what an empty table leaves
            yield from table.read(columns).to_batches() or [pa.RecordBatch.from_pylist([], table.schema_arrow if columns is None else pa.schema([table.schema_arrow.field(c) for c in columns]))]
        yield from table.iter_batches(batch_size=rows, columns=columns)
