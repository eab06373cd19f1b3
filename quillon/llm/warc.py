"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own. After the last frame a skippable frame holds the seek table:
compressed and decompressed size of each frame, then the number of frames, a descriptor and a magic number, so that a
reader can find any frame from the file's end. The index maps each record's identifier to its bundle, frame and offset
within the decompressed frame. Equal payloads are stored once: the record with the largest id is the response, the others
are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import shared_dir, slices, stored, table
from .files import NewFile, open_file

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 1 << 30, 3
#: Parts in which the copies of one payload are decided.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "quillon:warc")


def record_id(key, sha1: str, copy: str = "") -> str:
    """The identifier of the record of an id and a payload's digest; ``copy`` tells rows apart that have both in common."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{key} {sha1} {copy}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key, url: str | None, payload: bytes, refers_to=None, copy: str = "", named: bool = True) -> tuple[str, bytes]:
    """The identifier and the bytes of a WARC 1.1 response with the payload, or of a revisit without it. ``named``: whether
    the response that it refers to can be named, being the only record of its id and payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    sha1 = digest(payload)
    name = record_id(key, sha1, copy)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}", f"Quillon-Key: {'' if key is None else key}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"Quillon-Refers-To-Key: {refers_to}"] + [f"WARC-Refers-To: {record_id(refers_to, sha1)}"] * named
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def clean(url: str | None) -> str:
    """A header value: no line breaks, a placeholder where there is no URL."""
    return " ".join((url or "").split()) or "urn:x-missing"


def parse_records(data: bytes) -> Iterator[tuple[int, dict, bytes]]:
    """(offset, headers, block) of the records in decompressed bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        head = dict(line.split(": ", 1) for line in lines[1:])
        n = int(head["Content-Length"])
        yield at, head, data[end + 4 : end + 4 + n]
        at = end + 8 + n


def payload_of(block: bytes) -> tuple[int, bytes]:
    """The HTTP message's stated payload length, and the payload that is there."""
    head, _, body = block.partition(b"\r\n\r\n")
    n = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return n, body


class Bundle:
    """A bundle that is being written. Frames close at about ``frame_bytes``; a larger record is a frame of its own."""

    def __init__(self, name: str, frame_bytes: int = FRAME_BYTES):
        self.name, self.frame_bytes = name, frame_bytes
        self.out = NewFile(name)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.parts: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, rec: bytes) -> tuple[int, int]:
        """Frame and offset in it of a record."""
        if self.size and self.size + len(rec) > self.frame_bytes:
            self.flush()
        at = (len(self.frames), self.size)
        self.parts.append(rec)
        self.size += len(rec)
        return at

    def flush(self) -> None:
        if self.parts:
            data = self.zip.compress(b"".join(self.parts))
            self.out.write(data)
            self.frames.append((len(data), self.size))
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.__exit__(None, None, None)


def seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of the frames, from the footer."""
    f.seek(f.size() - 9)
    n, descriptor, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if descriptor & 128 else 8
    f.seek(f.size() - 9 - n * width)
    data, out, at = f.read(n * width), [], 0
    for k in range(n):
        a, b = struct.unpack_from("<II", data, k * width)
        out.append((at, a, b))
        at += a
    return out


def read_frame(f, entry: tuple[int, int, int]) -> bytes:
    f.seek(entry[0])
    return zstandard.ZstdDecompressor().decompress(f.read(entry[1]), max_output_size=max(1, entry[2]))


def read_record(file: str, frame: int, offset: int) -> tuple[dict, bytes]:
    """One record by its index entry: only its frame is read and decompressed."""
    with open_file(file) as f:
        data = read_frame(f, seek_table(f)[frame])
    return next((head, block) for _, head, block in parse_records(data[offset:]))


def roles(pages: DataFrame, least: int = 0, id_col: str = "page_id", data_col: str = "html") -> DataFrame:
    """``pages`` with the columns __to (the response that a revisit refers to, else null), __again (whether several rows have
    the row's id and payload) and __named (whether the response is not such a row).

    Of rows with equal payloads of at least ``least`` bytes, those with the largest id are responses; rows with a null id
    are responses too and nothing refers to them. Digests are decided on ids and digests alone, salted by the id, so that
    the copies of one page are spread; rows with their payloads are joined on their id and digest, which few share.
    """
    payload = F.coalesce(F.col(data_col).cast("binary"), F.lit(b""))
    rows = pages.withColumn("__sha1", F.sha1(payload))
    pairs = stored(rows.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"), "__sha1", F.octet_length(payload).alias("__size")).agg(F.count("*").alias("__n")), shared_dir(pages.sparkSession))
    large = pairs.filter(F.col("__size") >= least)
    top = large.groupBy("__sha1").agg(F.max(F.struct("__id", "__n")).alias("t"), F.count("*").alias("k")).filter("k > 1")
    top = top.select("__sha1", F.col("t.__id").alias("__top"), (F.col("t.__n") == 1).alias("__named"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("__salt"))
    links = large.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int")).join(top, ["__sha1", "__salt"]).filter("__id < __top").select("__id", "__sha1", "__top", "__named")
    facts = pairs.select("__id", "__sha1", "__n").join(links, ["__id", "__sha1"], "left").filter("__n > 1 OR __top IS NOT NULL")
    facts = stored(facts.select("__id", "__sha1", F.col("__top").alias("__to"), (F.col("__n") > 1).alias("__again"), "__named"), shared_dir(pages.sparkSession))
    # rows without an id are dealt by their payload and match nothing
    keyed = rows.withColumn("__key", F.struct(F.col(id_col).isNull(), F.coalesce(F.col(id_col), F.xxhash64(payload))))
    facts = facts.withColumn("__key", F.struct(F.lit(False), "__id")).drop("__id")
    joined = keyed.join(facts, ["__key", "__sha1"], "left").drop("__key", "__sha1")
    return joined.withColumn("__again", F.coalesce("__again", F.col(id_col).isNull())).withColumn("__named", F.coalesce("__named", F.lit(True)))


def write_archives(pages: DataFrame, where: str, least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html) and returns the index: page_id, record_id, file,
    frame, offset. Null html is an empty payload, very long ones are frames of their own; rows with one id are a record each,
    with identifiers of their own; an empty table gives no bundles; other columns are not read, so their names may clash.
    Each task writes bundles under names of its own, so a task that runs again disturbs nothing; the index, stored under
    ``where``, names only bundles of tasks that succeeded."""
    src = roles(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html")), least)
    src = src.select("page_id", "url", "__to", "__again", "__named", "html")
    schema = "page_id bigint, record_id string, file string, frame int, offset bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, k, bundle, at = TaskContext.get(), 0, None, 0
        rows: list = []

        def done():
            bundle.close()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()))], names=names)

        for whole in batches:
            for batch in slices(whole, "html"):
                for key, url, to, again, named, html in zip(*(c.to_pylist() for c in batch.columns)):
                    if bundle is None:
                        bundle = Bundle(f"{where}/bundles/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{k:04d}.warc.zst", frame_bytes)
                    at += 1
                    name, data = record(key, url, html or b"", to, f"{ctx.partitionId()}.{at}" if again else "", named)
                    frame, offset = bundle.add(data)
                    rows.append((key, name, bundle.name, frame, offset))
                    if bundle.out.at >= bundle_bytes:
                        yield done()
                        bundle, rows, k = None, [], k + 1
        if bundle is not None:
            yield done()

    return stored(src.mapInArrow(run, schema), f"{where}/index")


def read_archives(index: DataFrame) -> DataFrame:
    """A row for each record of the index's bundles: page_id, payload_bytes, payload_digest, record_type, refers_to. Each
    bundle is read frame by frame by a task of its own; digests of stored payloads are verified."""
    files = index.select("file").distinct()
    files = files.repartition(max(1, files.count()))
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open_file(name) as f:
                    for entry in seek_table(f):
                        rows = [row(head, block) for _, head, block in parse_records(read_frame(f, entry))]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=names)

    return files.mapInArrow(run, schema)


def row(head: dict, block: bytes) -> tuple:
    n, body = payload_of(block)
    kind, sha1 = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(body) != n or digest(body) != sha1):
        raise ValueError(f"{head['WARC-Record-ID']}: the payload is not what its digest says")
    key, to = head["Quillon-Key"], head.get("Quillon-Refers-To-Key")
    return int(key) if key else None, n, sha1, kind, int(to) if to else None


#: The same for DuckDB. Base32 takes five bits of the digest for each letter.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
     q AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(d, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM q
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"), shared_dir(spark)))
