"""Length-delimited binary records of token ids, with a separate offset index.

A record is: length of the payload (8 bytes, little-endian), masked CRC-32C of those 8 bytes, payload, masked CRC-32C of
the payload. A payload is: document id (8 bytes), flags (4 bytes; bit 0: the id is null), bytes per token id (4 bytes), ids.
Records lie in ascending order of the document id, over shards in the same order. The index names for each record its
shard, byte offset and length, so that a shuffled reader can fetch any record by one ranged read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import shared_dir, slices, stored, table
from .files import NewFile, open_file
from .wordtable import word_ids

#: Fixed values of the format: the reflected Castagnoli polynomial and the mask's constant.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
HEAD, HEAD_SIZE = "<qII", 16
LANE = 128


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


T8 = _byte_table()
_LOW = np.arange(65536, dtype=np.uint32)
#: Two bytes at once: the register after them, for each value of (register ^ data) in 16 bits.
T16 = T8[(T8[_LOW & 255] ^ (_LOW >> 8)) & 255] ^ (T8[_LOW & 255] >> 8)
_SHIFTS: list[np.ndarray] = []


def _shift_tables(level: int) -> np.ndarray:
    """Tables (4 by 256) that carry a register over LANE * 2**level zero bytes."""
    while len(_SHIFTS) <= level:
        if not _SHIFTS:
            bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
            for _ in range(LANE):
                bits = T8[bits & 255] ^ (bits >> 8)
        else:
            bits = _apply(_SHIFTS[-1], _apply(_SHIFTS[-1], np.uint32(1) << np.arange(32, dtype=np.uint32)))
        table_ = np.zeros((4, 256), np.uint32)
        for k in range(4):
            for b in range(8):
                table_[k, np.arange(256) & (1 << b) != 0] ^= bits[8 * k + b]
        _SHIFTS.append(table_)
    return _SHIFTS[level]


def _apply(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    return t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]


def crc32c(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32C of each part buf[offsets[i]:offsets[i + 1]], all at once.

    The register is linear in the data: each part, zero-padded in front, is cut into lanes of LANE bytes that are run in
    step, and the lanes' registers are joined in pairs. The initial value of all ones is the flip of the first four bytes.
    """
    sizes = np.diff(offsets)
    lanes = -(-np.maximum(sizes, 4) // LANE)
    ends = np.cumsum(lanes)
    flat = np.zeros(int(ends[-1]) * LANE if len(ends) else 0, np.uint8)
    begin = ends * LANE - sizes
    for to, lo, n in zip(begin.tolist(), offsets.tolist(), sizes.tolist()):
        flat[to : to + n] = buf[lo : lo + n]
    first = np.minimum(begin, ends * LANE - 4)  # for parts of under 4 bytes the flip lies before the data and is carried along
    for k in range(4):
        flat[np.where(sizes >= 4, begin, first) + k] ^= 255
    if (short := np.flatnonzero((sizes < 4))).size:
        out_short = {int(i): _plain(buf[offsets[i] : offsets[i + 1]].tobytes()) for i in short}
    steps = flat.view("<u2").reshape(-1, LANE // 2).T.astype(np.uint32, order="C")
    reg = np.zeros(steps.shape[1], np.uint32)
    for row in steps:
        reg = T16[(reg ^ row) & 65535] ^ (reg >> 16)
    level = 0
    while len(reg) > len(sizes):
        n = np.diff(np.concatenate(([0], ends)))
        half = (n + 1) // 2
        new_ends = np.cumsum(half)
        back = np.repeat(new_ends, half) - 1 - np.arange(int(new_ends[-1]))  # position counted from the part's last
        right = np.repeat(ends, half) - 1 - 2 * back
        has = 2 * back + 1 < np.repeat(n, half)
        joined = reg[right].copy()
        joined[has] ^= _apply(_shift_tables(level), reg[right[has] - 1])
        reg, ends, level = joined, new_ends, level + 1
    crc = reg ^ np.uint32(0xFFFFFFFF)
    if short.size:
        for i, v in out_short.items():
            crc[i] = v
    return crc


def _plain(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = int(T8[(c ^ b) & 255]) ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> list[bytes]:
    """The framed records of payloads."""
    heads = np.array([len(p) for p in payloads], "<u8")
    of_head = masked(crc32c(heads.view(np.uint8), np.arange(len(payloads) + 1) * 8)).astype("<u4")
    of_data = masked(crc32c(np.frombuffer(b"".join(payloads), np.uint8), np.cumsum([0] + [len(p) for p in payloads]))).astype("<u4")
    return [heads[i].tobytes() + of_head[i].tobytes() + p + of_data[i].tobytes() for i, p in enumerate(payloads)]


def unframe(data: bytes) -> list[bytes]:
    """The payloads of whole records; a ValueError if a checksum or a length does not hold."""
    out, at, heads, sums = [], 0, [], []
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a record is cut off")
        n = int.from_bytes(data[at : at + 8], "little")
        if at + 16 + n > len(data):
            raise ValueError("a record is cut off")
        heads.append(data[at : at + 8])
        out.append(data[at + 12 : at + 12 + n])
        sums.append((int.from_bytes(data[at + 8 : at + 12], "little"), int.from_bytes(data[at + 12 + n : at + 16 + n], "little")))
        at += 16 + n
    if out:
        want = np.array(sums, np.uint32)
        got = masked(crc32c(np.frombuffer(b"".join(heads), np.uint8), np.arange(len(out) + 1) * 8))
        body = masked(crc32c(np.frombuffer(b"".join(out), np.uint8), np.cumsum([0] + [len(p) for p in out])))
        if (got != want[:, 0]).any() or (body != want[:, 1]).any():
            raise ValueError("a checksum does not hold")
    return out


#: Bytes of records that are framed or read at once.
BLOCK = 4_000_000


def write_records(docs: DataFrame, path: str, vocabulary: int, end_id: int, where: str, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends ``end_id``, writes shards under ``where`` in ascending order of the id and returns the
    index (shard, file, position in the shard, offset, length, n_tokens), which is stored under ``where`` as well.

    Null ids come first, null texts count as empty, rows with equal ids are all written. ``vocabulary``: the number of ids,
    which decides between 2 and 4 bytes for each. A task that is run again writes files of its own name; the index names
    only files of tasks that succeeded.
    """
    width = 2 if vocabulary <= 1 << 16 else 4
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]  # rows with one id can still be dealt over shards
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = src.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    schema = "shard int, file string, position bigint, offset bigint, length bigint, doc_id bigint, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, words = TaskContext.get(), word_ids(path, width)
        shard, name = ctx.partitionId(), f"{where}/shards/shard-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.rec"
        batches = (b for whole in batches for b in slices(whole, "text", BLOCK))
        head = next(batches, None)
        if head is None:
            return
        position = 0
        rows = []
        with NewFile(name) as out:
            while head is not None:
                ids, texts = head.column("doc_id").to_pylist(), [x or b"" for x in head.column("text").to_pylist()]
                payloads = list(_payloads(words, ids, texts, end_id, width))
                offset, sizes = out.at, []
                for rec in frame(payloads):
                    out.write(rec)
                    sizes.append(len(rec))
                offsets = offset + np.cumsum([0, *sizes[:-1]])
                tokens = [(len(p) - HEAD_SIZE) // width for p in payloads]
                rows.append((np.arange(position, position + len(ids)), offsets, sizes, ids, tokens))
                position += len(ids)
                head = next(batches, None)
        for pos, offsets, sizes, ids, tokens in rows:
            k = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * k, pa.int32()), pa.array([name] * k), pa.array(pos), pa.array(offsets), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(tokens, pa.int64())], names=schema_names)

    schema_names = [x.split()[0] for x in schema.split(", ")]
    return stored(ordered.mapInArrow(run, schema), f"{where}/index")


def _payloads(words, ids: list, texts: list, end_id: int, width: int) -> Iterator[bytes]:
    end = end_id.to_bytes(width, "little")
    for d, packed in zip(ids, words.packed(texts)):
        yield struct.pack(HEAD, d or 0, d is None, width) + packed + end


def read_records(index: DataFrame) -> DataFrame:
    """What the shards of an index hold: doc_id, start (ids in all records before), n_tokens, ids_crc32 (of the ids as
    little-endian 32-bit integers). Each shard is read by one task in blocks of bounded size; checksums are verified."""
    spark = index.sparkSession
    shards = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n"), F.max(F.col("offset") + F.col("length")).alias("size")).orderBy("shard").collect()  # a row for each file
    starts = np.cumsum([0] + [r["n"] for r in shards]).tolist()
    files = spark.createDataFrame([(r["file"], starts[i], r["size"]) for i, r in enumerate(shards)], "file string, start bigint, size bigint").repartition(max(1, len(shards)))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                for payloads in _blocks(row["file"], row["size"]):
                    out: list = [[], [], [], []]
                    for p in payloads:
                        d, flags, width = struct.unpack_from(HEAD, p)
                        ids = np.frombuffer(p, "<u2" if width == 2 else "<u4", offset=HEAD_SIZE)
                        for k, v in zip(out, (None if flags & 1 else d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                            k.append(v)
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    return files.mapInArrow(run, schema)


def _blocks(name: str, size: int) -> Iterator[list[bytes]]:
    """The payloads of a file, in blocks of about BLOCK bytes of whole records."""
    with open_file(name) as f:
        if f.size() != size:
            raise ValueError(f"{name} has {f.size()} bytes, the index says {size}")
        rest = b""
        while True:
            data = rest + f.read(BLOCK)
            if not data:
                return
            at = cut = 0
            while at + 8 <= len(data):
                at += 16 + int.from_bytes(data[at : at + 8], "little")
                if at > len(data):
                    break
                cut = at
            if not cut:
                need = 16 + int.from_bytes(data[:8], "little") - len(data) if len(data) >= 8 else 8
                more = f.read(max(1, need))
                if not more:
                    raise ValueError(f"{name} is cut off")
                rest = data + more
                continue
            yield unframe(data[:cut])
            rest = data[cut:]


def read_record(file: str, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """One record by its index entry: document id and token ids."""
    with open_file(file) as f:
        f.seek(offset)
        p = unframe(f.read(length))[0]
    d, flags, width = struct.unpack_from(HEAD, p)
    return None if flags & 1 else d, np.frombuffer(p, "<u2" if width == 2 else "<u4", offset=HEAD_SIZE)


def op2_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    index = write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 49_408, 1, shared_dir(spark))
    return read_records(index)
