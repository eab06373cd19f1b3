"""ISO base media files: writing lossless sample tracks and reading tables, codec, duration and keyframes.

The reader walks nested boxes and decodes the sample tables of ``moov`` and the runs of ``moof``; it never touches the
payload in ``mdat``. What it stores about a file is the codec, the duration and the byte range of each keyframe.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .base import map_texts, table

#: Fixed values of the format (ISO/IEC 14496-12): boxes that hold boxes, and the bytes of their own fields before those.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"udta": 0}

WIDTH, HEIGHT, FPS, FRAMES_PER_CHUNK, KEY_EVERY = 16, 12, 25, 8, 25
FRAME = WIDTH * HEIGHT


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_frames(payload: bytes, key_every: int = KEY_EVERY, frames_per_chunk: int = FRAMES_PER_CHUNK) -> bytes:
    """A file with one video track of uncompressed 8-bit grey frames of 16 by 12 samples, which are the payload's bytes.

    The payload's length must be a positive multiple of 192. Every ``key_every``-th frame is marked as a sync sample.
    The bytes depend on the payload alone.
    """
    if not payload or len(payload) % FRAME:
        raise ValueError(f"a payload has a positive multiple of {FRAME} bytes")
    n = len(payload) // FRAME
    chunks = -(-n // frames_per_chunk)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    runs = [(1, frames_per_chunk, 1)] if n % frames_per_chunk == 0 else [(1, frames_per_chunk, 1)] * (chunks > 1) + [(chunks, n % frames_per_chunk, 1)]
    keys = np.arange(1, n + 1, key_every, dtype=">u4")
    head = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  isom")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (frames_per_chunk * FRAME)
        wide = first + len(payload) >= 1 << 32
        table_ = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        info = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table_)
        media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, FPS, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), info)
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), bytes(8), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7), media)
        return box(b"moov", full(b"mvhd", struct.pack(">IIII", 0, 0, FPS, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2)), track)

    data = 8 if len(payload) + 8 < 1 << 32 else 16
    size = len(moov(0))
    if len(head) + size + data + len(payload) >= 1 << 32:
        size = len(moov(1 << 32))
    return b"".join((head, moov(len(head) + size + data), box(b"mdat", payload)))


def boxes(buf: memoryview, lo: int = 0, hi: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body from, body to) of the boxes in a range: 64-bit sizes and size 0 (to the end) are understood."""
    hi = len(buf) if hi is None else hi
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", buf, lo)
        body = lo + 8
        if size == 1:
            if body + 8 > hi:
                raise ValueError("a box is cut off")
            size, body = struct.unpack_from(">Q", buf, body)[0], body + 8
        elif size == 0:
            size = hi - lo
        if size < body - lo or lo + size > hi:
            raise ValueError("a box is cut off")
        if kind == b"uuid":
            body += 16
        yield kind, body, lo + size
        lo += size


def walk(buf: memoryview, lo: int = 0, hi: int | None = None, path: tuple = (), depth: int = 16) -> Iterator[tuple[tuple, int, int]]:
    """Every box with its path, parents first. Deeper nesting than ``depth`` is an error, so no file recurses for ever."""
    if not depth:
        raise ValueError("boxes are nested too deeply")
    for kind, a, b in boxes(buf, lo, hi):
        yield (*path, kind), a, b
        if kind in CONTAINERS:
            yield from walk(buf, a + CONTAINERS[kind], b, (*path, kind), depth - 1)


@dataclass
class Track:
    """One track: codec, timescale, duration (in that scale) and, for each sample, offset, size and whether it is a keyframe."""

    number: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    key: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def keyframes(self) -> list[tuple[int, int]]:
        return list(zip(self.offsets[self.key].tolist(), self.sizes[self.key].tolist()))

    def payload(self, buf: bytes) -> bytes:
        """The samples' bytes in decoding order."""
        if len(self.offsets) and bool((self.offsets[1:] == self.offsets[:-1] + self.sizes[:-1]).all()):
            return bytes(buf[int(self.offsets[0]) : int(self.offsets[-1] + self.sizes[-1])])
        return b"".join(bytes(buf[o : o + s]) for o, s in zip(self.offsets.tolist(), self.sizes.tolist()))


def _ints(buf: memoryview, at: int, n: int, kind: str = ">u4") -> np.ndarray:
    if n < 0 or at + n * np.dtype(kind).itemsize > len(buf):
        raise ValueError("a table is cut off")
    return np.frombuffer(buf, kind, n, at).astype(np.int64)


def _u32(buf: memoryview, at: int) -> int:
    return struct.unpack_from(">I", buf, at)[0]


def parse(data: bytes) -> list[Track]:
    """The tracks of a file. Malformed files raise ValueError."""
    buf = memoryview(data)
    try:
        return _parse(buf)
    except (struct.error, IndexError) as e:
        raise ValueError(f"malformed: {e}") from None


def _parse(buf: memoryview) -> list[Track]:
    tracks: list[Track] = []
    defaults: dict = {}
    by: dict = {}
    moof, fragment = 0, {}
    raw: dict = {}
    for path, a, b in walk(buf):
        kind = path[-1]
        if kind == b"moof":
            moof = next(lo for lo in (a - 8, a - 16) if bytes(buf[lo + 4 : lo + 8]) == b"moof")
        if kind == b"trak":
            tracks.append(Track())
            raw = by[id(tracks[-1])] = {}
        elif kind == b"trex":
            number, _, duration, size, flags = struct.unpack_from(">5I", buf, a + 4)
            defaults[number] = (duration, size, flags)
        elif kind == b"tfhd":
            fragment = _tfhd(buf, a, moof, defaults)
        elif kind == b"trun":
            _trun(buf, a, fragment, tracks)
        elif b"trak" in path and tracks:
            t = tracks[-1]
            long = buf[a] == 1 if b > a else False
            if kind == b"tkhd":
                t.number = _u32(buf, a + (20 if long else 12))
            elif kind == b"mdhd":
                t.timescale, t.duration = struct.unpack_from(">IQ" if long else ">II", buf, a + (20 if long else 12))
            elif kind == b"hdlr":
                t.handler = bytes(buf[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"stsd" and _u32(buf, a + 4):
                t.codec = bytes(buf[a + 12 : a + 16]).decode("latin-1")
            elif kind == b"stsz":
                same, n = struct.unpack_from(">II", buf, a + 4)
                raw["sizes"] = np.full(n, same, np.int64) if same else _ints(buf, a + 12, n)
            elif kind == b"stz2":
                bits, n = buf[a + 7], _u32(buf, a + 8)
                four = _ints(buf, a + 12, (n + 1) // 2, ">u1") if bits == 4 else None
                raw["sizes"] = np.stack([four >> 4, four & 15], 1).ravel()[:n] if bits == 4 else _ints(buf, a + 12, n, ">u1" if bits == 8 else ">u2")
            elif kind in (b"stco", b"co64"):
                raw["chunks"] = _ints(buf, a + 8, _u32(buf, a + 4), ">u4" if kind == b"stco" else ">u8")
            elif kind == b"stsc":
                raw["runs"] = _ints(buf, a + 8, 3 * _u32(buf, a + 4)).reshape(-1, 3)
            elif kind == b"stts":
                raw["times"] = _ints(buf, a + 8, 2 * _u32(buf, a + 4)).reshape(-1, 2)
            elif kind == b"stss":
                raw["keys"] = _ints(buf, a + 8, _u32(buf, a + 4))
    for t in tracks:
        if "sizes" in by[id(t)]:
            _tables(t, by[id(t)])
    return tracks


def _tables(t: Track, raw: dict) -> None:
    """Sample offsets, times and keyframes from the tables of a track, in front of what fragments have added."""
    sizes, n = raw["sizes"], len(raw["sizes"])
    chunks, runs = raw.get("chunks", np.zeros(0, np.int64)), raw.get("runs", np.zeros((0, 3), np.int64))
    per = np.zeros(len(chunks), np.int64)
    if len(runs) and len(chunks):
        per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunks))).clip(0))[: len(chunks)]
    if per.sum() < n:
        raise ValueError("a sample has no chunk")
    chunk = np.repeat(np.arange(len(per)), per)[:n]
    before = np.concatenate(([0], np.cumsum(sizes)))
    first = np.concatenate(([0], np.cumsum(per)))[chunk] if n else chunk
    offsets = chunks[chunk] + before[:-1] - before[first] if n else np.zeros(0, np.int64)
    times = raw.get("times", np.zeros((0, 2), np.int64))
    steps = np.repeat(times[:, 1], times[:, 0])[:n]
    key = np.ones(n, bool) if "keys" not in raw else np.isin(np.arange(1, n + 1), raw["keys"])
    t.offsets, t.sizes, t.key = np.concatenate((offsets, t.offsets)), np.concatenate((sizes, t.sizes)), np.concatenate((key, t.key))
    t.times = np.concatenate((np.cumsum(steps) - steps, t.times))


def _tfhd(buf: memoryview, a: int, moof: int, defaults: dict) -> dict:
    flags, number = _u32(buf, a) & 0xFFFFFF, _u32(buf, a + 4)
    duration, size, sample = defaults.get(number, (0, 0, 0))
    at, base = a + 8, moof
    if flags & 1:
        base, at = struct.unpack_from(">Q", buf, at)[0], at + 8
    at += 4 * bool(flags & 2)
    if flags & 8:
        duration, at = _u32(buf, at), at + 4
    if flags & 16:
        size, at = _u32(buf, at), at + 4
    if flags & 32:
        sample = _u32(buf, at)
    return {"number": number, "base": base, "next": base, "duration": duration, "size": size, "flags": sample}


def _trun(buf: memoryview, a: int, f: dict, tracks: list) -> None:
    flags, n = _u32(buf, a) & 0xFFFFFF, _u32(buf, a + 4)
    t = next((t for t in tracks if t.number == f.get("number")), None)
    if t is None:
        raise ValueError("a fragment of no track")
    at, start = a + 8, f["next"]
    if flags & 1:
        start, at = f["base"] + struct.unpack_from(">i", buf, at)[0], at + 4
    first, at = (_u32(buf, at), at + 4) if flags & 4 else (None, at)
    width = sum(bool(flags & x) for x in (0x100, 0x200, 0x400, 0x800))
    rows = _ints(buf, at, n * width).reshape(n, width)
    col = iter(range(width))
    steps = rows[:, next(col)] if flags & 0x100 else np.full(n, f["duration"], np.int64)
    sizes = rows[:, next(col)] if flags & 0x200 else np.full(n, f["size"], np.int64)
    marks = rows[:, next(col)].copy() if flags & 0x400 else np.full(n, f["flags"], np.int64)
    if first is not None and n:
        marks[0] = first
    ends = np.cumsum(sizes)
    f["next"] = start + int(ends[-1]) if n else start
    t.times = np.concatenate((t.times, t.duration + np.cumsum(steps) - steps))
    t.duration += int(steps.sum())
    t.offsets, t.sizes = np.concatenate((t.offsets, start + ends - sizes)), np.concatenate((t.sizes, sizes))
    t.key = np.concatenate((t.key, (marks & 0x10000) == 0))


def describe(data: bytes) -> dict | None:
    """codec, duration in seconds, samples and keyframe ranges of the first track; None for what is no media file."""
    try:
        tracks = parse(data)
    except ValueError:
        return None
    if not tracks:
        return None
    t = tracks[0]
    return {"codec": t.codec, "handler": t.handler, "seconds": t.duration / t.timescale if t.timescale else None, "samples": len(t.sizes), "keyframes": t.keyframes()}


def feature(t: Track) -> str:
    """Codec, duration, samples, and the keyframes' count, first range, last range and digest of all ranges."""
    keys = np.stack([t.offsets[t.key], t.sizes[t.key]], 1).astype("<i8")
    ends = [f"{o}+{s}" for o, s in keys[[0, -1]].tolist()] if len(keys) else ["-", "-"]
    return f"codec={t.codec.strip()} duration={t.duration}/{t.timescale} samples={len(t.sizes)} keyframes={len(keys)} first={ends[0]} last={ends[1]} ranges={zlib.crc32(keys.tobytes()):08x}"


def stored_media(texts: list) -> dict:
    """Texts stored as media files and read back."""
    out: dict = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
    for t in texts:
        data = write_frames(t + b" " * (-len(t) % FRAME or FRAME * (not t)))
        track = parse(data)[0]
        back = track.payload(data)
        for k, v in zip(out, (len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(track))):
            out[k].append(v)
    return out


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: its text, padded with spaces to a positive multiple of 192 bytes, as a media file that is
    read back. Null texts count as empty (192 spaces); equal texts give equal values; other columns are not read."""
    schema = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_texts(docs, stored_media, schema, id_col, text_col, keep)


def keyframe_table(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """For a table of media files (binary): id, codec, seconds, samples and an array of keyframe (offset, size); nulls for
    rows that are null or no media files."""

    def run(blobs: list) -> dict:
        got = [describe(x) for x in blobs]
        return {"codec": [g and g["codec"] for g in got], "seconds": [g and g["seconds"] for g in got], "samples": [g and g["samples"] for g in got], "keyframes": _ranges(got)}

    return map_texts(files, run, "codec string, seconds double, samples bigint, keyframes array<struct<offset:bigint,size:bigint>>", id_col, data_col)


def _ranges(got: list):
    import pyarrow as pa

    rows = [None if g is None else [{"offset": o, "size": s} for o, s in g["keyframes"]] for g in got]
    return pa.array(rows, pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())])))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
