"""A change table as a stream: a Python data source with offsets, partitions and commits.

The table is a folder of Parquet files that only grows: files are read in the order of their names, rows in the order in
which they stand. An offset is a number of files and of rows in the next one. A batch is a range of offsets, cut at files
and at ``partitionRows``, so each task reads a bounded slice of one file. With ``rowsPerBatch`` a batch takes that many rows
at most, with ``bytesPerBatch`` that many bytes (uncompressed, as the row groups tell; one row at least), and the rest waits
in the table: a burst makes more batches, not larger ones.

Commits are noted in the folder ``state`` where one is given; a query that is started again without its checkpoint goes on
from there.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

NAME = "quillon_changes"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def files_of(folder: str) -> list[str]:
    """The table's files by name; a table may be one file. Names with a leading . or _ are drafts."""
    system, path = place(folder)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))


def rows_in(folder: str, file: str) -> int:
    return pq.read_metadata(place(folder)[0].open_input_file(file)).num_rows


def groups_in(folder: str, file: str, start: int) -> Iterator[tuple[int, float]]:
    """(rows, bytes of a row) of what each row group of a file holds from row ``start`` on."""
    table = pq.read_metadata(place(folder)[0].open_input_file(file))
    for g in (table.row_group(k) for k in range(table.num_row_groups)):
        left = min(g.num_rows, max(g.num_rows - start, 0))
        start = max(start - g.num_rows, 0)
        if left:
            yield left, g.total_byte_size / g.num_rows


class Slice(InputPartition):
    """Rows from ``start`` up to ``end`` of one file."""

    def __init__(self, file: str, start: int, end: int):
        super().__init__(file)
        self.file, self.start, self.end = file, start, end


def slices(folder: str, start: tuple[int, int], end: tuple[int, int], most: int) -> list[Slice]:
    out = []
    names = files_of(folder)
    for k in range(start[0], min(end[0] + 1, len(names))):
        lo = start[1] if k == start[0] else 0
        hi = end[1] if k == end[0] else rows_in(folder, names[k])
        out += [Slice(names[k], a, min(a + most, hi)) for a in range(lo, hi, most)]
    return out


def read_slice(folder: str, part: Slice, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a slice; row groups outside of it are not read."""
    with place(folder)[0].open_input_file(part.file) as f:
        table = pq.ParquetFile(f)
        at = 0
        for g in range(table.num_row_groups):
            n = table.metadata.row_group(g).num_rows
            lo, hi = max(part.start - at, 0), min(part.end - at, n)
            if lo < hi:
                rows = table.read_row_group(g, columns=schema.names).slice(lo, hi - lo)
                yield from rows.select(schema.names).cast(schema).to_batches()
            at += n


class ChangeSource(DataSource):
    """Options: path (the folder), rowsPerBatch, bytesPerBatch, partitionRows (100,000), state. The schema is the table's unless one is given."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        folder = self.options["path"]
        return from_arrow_schema(pq.read_schema(place(folder)[0].open_input_file(files_of(folder)[0])))

    def reader(self, schema) -> DataSourceReader:
        return TableReader(self.options, to_arrow_schema(schema))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangeReader(self.options, to_arrow_schema(schema))


class TableReader(DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema):
        self.folder, self.rows, self.schema_ = options["path"], int(options.get("partitionRows", 100_000)), schema

    def partitions(self) -> list[Slice]:
        return slices(self.folder, (0, 0), (len(files_of(self.folder)), 0), self.rows)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return read_slice(self.folder, partition, self.schema_)


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: pa.Schema):
        self.folder, self.rows, self.schema_ = options["path"], int(options.get("partitionRows", 100_000)), schema
        self.most, self.bytes = (float(options.get(k, "inf")) for k in ("rowsPerBatch", "bytesPerBatch"))
        self.state = options.get("state")
        if min(self.most, self.bytes) < float("inf") and not self.state:
            raise ValueError("rowsPerBatch and bytesPerBatch need state: a reader that starts again must know what was read")
        self.at = self._noted()

    def _noted(self) -> tuple[int, int]:
        if not self.state:
            return 0, 0
        system, path = place(self.state)
        at = posixpath.join(path, "offset.json")
        if system.get_file_info(at).type != fs.FileType.File:
            return 0, 0
        with system.open_input_stream(at) as f:
            found = json.loads(f.read())
        return found["file"], found["row"]

    def initialOffset(self) -> dict:
        return dict(zip(("file", "row"), self._noted()))

    def latestOffset(self) -> dict:
        """The end of what is there, or as far after the end of the last batch as a batch may go."""
        names, (k, row), rows, size, taken = files_of(self.folder), self.at, self.most, self.bytes, 0
        while k < len(names):
            for here, each in groups_in(self.folder, names[k], row):
                can = int(min(here, rows, max(size // max(each, 1e-9), 0 if taken else 1)))
                row, rows, size, taken = row + can, rows - can, size - can * each, taken + can
                if can < here:
                    return {"file": k, "row": row}
            if k + 1 == len(names):  # the last file may be all there is for now: stay behind its rows
                break
            k, row = k + 1, 0
        return {"file": k, "row": row}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.at = max(self.at, (end["file"], end["row"]))
        return slices(self.folder, (start["file"], start["row"]), (end["file"], end["row"]), self.rows)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return read_slice(self.folder, partition, self.schema_)

    def commit(self, end: dict) -> None:
        if not self.state:
            return
        system, path = place(self.state)
        system.create_dir(path, recursive=True)
        part = posixpath.join(path, ".offset.part")
        with system.open_output_stream(part) as f:
            f.write(json.dumps(end).encode())
        system.move(part, posixpath.join(path, "offset.json"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeSource)
