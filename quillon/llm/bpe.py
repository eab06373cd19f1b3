"""Byte-level BPE encoding and decoding by a rank file.

A piece's merges are found with a segment tree over its byte positions. A leaf holds the rank of the pair that begins
there, an inner node the minimum of its children, so the root names the lowest rank and the leftmost pair that has it. A
merge joins two live neighbours and updates three leaves, each in logarithmic time. Many pieces have their trees side by
side in one array and merge in step; single long pieces have a tree of their own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .base import map_texts, table
from .wordtable import Memo

NONE = 1 << 62
#: Pieces of up to LEAVES byte pairs merge in step, where at least TOGETHER of about one length are at hand; CELLS of their
#: trees are built at once.
LEAVES, TOGETHER, CELLS = 1024, 8, 1 << 19
#: Bytes of ids, names or text that are put together at once.
PART = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: pairs merge in the order of rank, the leftmost first among equals."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 2).bit_length()
    get = ranks.get
    tree = [NONE] * (2 * size)
    tree[size : size + n - 1] = [get(piece[i : i + 2], NONE) for i in range(n - 1)]
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of live parts, by their first byte

    def put(i: int, rank: int) -> None:
        i += size
        tree[i] = rank
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a <= b else b
            if tree[i] == low:
                return
            tree[i] = low

    while (low := tree[1]) < NONE:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != low:
                i += 1
        at = i - size
        gone = after[at]
        end = after[at] = after[gone]
        if gone < size:
            put(gone, NONE)
        if end < n:
            before[end] = at
            put(at, get(piece[at : after[end]], NONE))
        else:
            put(at, NONE)
        if (left := before[at]) >= 0:
            put(left, get(piece[left:end], NONE))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class Pairs:
    """The rank of what two tokens make together, by their ids: an open-addressing table of all pairs that make a token."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte has no rank")
        get = ranks.get
        found = [(a, b, r) for w, r in ranks.items() for k in range(1, len(w)) if (a := get(w[:k])) is not None and (b := get(w[k:])) is not None]
        a, b, rank = (np.array(x, np.int64) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bits = max(8, (4 * len(rank)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        key = a << 32 | b
        at, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = key[free]  # of several for one slot the last stays
            won = free[self.keys[at[free]] == key[free]]
            self.values[at[won]] = rank[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = self._slot(key)
        got = self.keys[at]
        wrong = np.flatnonzero((got != key) & (got >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            got[wrong] = self.keys[at[wrong]]
            wrong = wrong[(got[wrong] != key[wrong]) & (got[wrong] >= 0)]
        return np.where(got == key, self.values[at], NONE)


def merge_together(pieces: list[bytes], size: int, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces of 2 to ``size`` + 1 bytes, one after the other, and their number for each. ``size``: a power of two.

    A cell of a tree is a rank and, below it, the leaf's place, so that the minimum is the leftmost pair of lowest rank.
    """
    n = np.array([len(p) for p in pieces], np.int64)
    rows, width, low = len(pieces), size + 1, size.bit_length() + 1
    ids = np.zeros((rows, width + 1), np.int64)
    live = np.arange(width + 1) < n[:, None]
    ids[live] = pairs.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    place = np.arange(size)

    def cells(rank: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.where(rank < NONE, rank << low | where, NONE)

    tree = np.full((rows, 2 * size), NONE, np.int64)
    has = live[:, 1:width]
    r, c = np.nonzero(has)
    tree[r, size + c] = cells(pairs(ids[r, c], ids[r, c + 1]), c)
    w = size
    while w > 1:
        np.minimum(tree[:, w : 2 * w : 2], tree[:, w + 1 : 2 * w : 2], out=tree[:, w // 2 : w])
        w //= 2
    after, before = np.tile(np.arange(1, width + 2), (rows, 1)), np.tile(np.arange(-1, width), (rows, 1))
    ids, live, after, before, flat = ids.ravel(), live.ravel(), after.ravel(), before.ravel(), tree.ravel()
    row, step = np.arange(rows), width + 1
    while True:
        root = flat[row * (2 * size) + 1]
        row, root = row[root < NONE], root[root < NONE]
        if not len(row):
            break
        base, at = row * step, root & ((1 << low) - 1)
        gone = after[base + at]
        end = after[base + gone]
        ids[base + at], after[base + at], live[base + gone] = root >> low, end, False
        before[base + np.minimum(end, width)] = at
        left = before[base + at]
        right = np.full(len(row), NONE, np.int64)
        k = np.flatnonzero(end < n[row])
        right[k] = cells(pairs(ids[base[k] + at[k]], ids[base[k] + end[k]]), at[k])
        k = np.flatnonzero(left >= 0)
        new = cells(pairs(ids[base[k] + left[k]], ids[base[k] + at[k]]), left[k])
        inside = gone < size  # the last byte begins no pair
        cell = np.concatenate((row * (2 * size) + size + at, (row * (2 * size) + size + gone)[inside], row[k] * (2 * size) + size + left[k]))
        flat[cell] = np.concatenate((right, np.full(int(inside.sum()), NONE, np.int64), new))
        top = np.concatenate((row, row[inside], row[k])) * (2 * size)
        node = (cell - top) >> 1
        while node[0]:  # all leaves are at one depth
            flat[top + node] = np.minimum(flat[top + 2 * node], flat[top + 2 * node + 1])
            node >>= 1
    live = live.reshape(rows, step)
    return ids.reshape(rows, step)[live], live.sum(1)


class Codec:
    """Encodes and decodes whole texts. Results of parts of texts are remembered, about ``most`` of them, which changes no
    result."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 1_000_000):
        import regex

        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.find = regex.compile(pattern).findall
        self.memo = Units(self._learn, most)
        size = max(ranks.values()) + 1
        by: list = [b""] * size
        for word, rank in ranks.items():
            by[rank] = word
        self.words, self.names = Pool(by), Pool([b"%d " % i for i in range(size)])

    def pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The packed ids (little-endian, 4 bytes) of distinct pieces."""
        out: dict = {}
        groups: dict = {}
        for p in pieces:
            raw = p.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:
                out[p] = whole.to_bytes(4, "little")
            else:
                groups.setdefault(1 << (len(raw) - 2).bit_length(), []).append((p, raw))
        for size, rows in groups.items():
            if size > LEAVES or len(rows) < TOGETHER:
                out.update((p, np.array(merge(raw, self.ranks), "<u4").tobytes()) for p, raw in rows)
                continue
            some = max(1, CELLS // (2 * size))
            for lo in range(0, len(rows), some):
                part = rows[lo : lo + some]
                ids, count = merge_together([raw for _, raw in part], size, self.pairs)
                packed, ends = ids.astype("<u4").tobytes(), (np.cumsum(count) * 4).tolist()
                out.update((p, packed[a:b]) for (p, _), a, b in zip(part, [0, *ends], ends))
        return out

    def _learn(self, units: list) -> list[bytes]:
        """A unit is a str, which a space goes before, or a tuple of one str, the beginning of a text."""
        found = [self.find(u[0]) if isinstance(u, tuple) else self.find(" " + u) for u in units]
        ids = self.pieces(list(dict.fromkeys(chain.from_iterable(found))))
        return [ids[f[0]] if len(f) == 1 else b"".join(map(ids.__getitem__, f)) for f in found]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text: those of each match of the pattern, one after the other, as the tiktoken library's
        encode_ordinary gives them.

        A match takes a space along only at its front, and a space between two characters that are no white space always
        begins a match. The text is therefore cut there, and each unit's matches are found once.
        """
        return list(map(b"".join, self.memo.look(map(_units, texts))))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed([text])[0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.words.join(np.fromiter(ids, np.int64), [0])[0]


def _careful(parts: list[str]) -> Iterator:
    """The units of a text whose white space is not just single spaces between words."""
    first, unit = True, parts[0]
    for k in range(1, len(parts) + 1):
        nxt = parts[k] if k < len(parts) else None
        if nxt is not None and (not unit or unit[-1].isspace() or not nxt or nxt[0].isspace()):
            unit = f"{unit} {nxt}"
            continue
        yield (unit,) if first else unit
        first, unit = False, nxt


def _units(text: str) -> list:
    parts: list = text.split(" ")
    parts[0] = (parts[0],)
    return parts


class Units(Memo):
    """Keeps only units that a cut at spaces gives anywhere, so that a text of which all parts are known needs no look."""

    def kept(self, keys: Iterable) -> list:
        return [k for k in keys if isinstance(k, str) and k and len(k) <= self.longest and k.strip() == k and " " not in k]

    def instead(self, keys: list, unknown: list) -> list:
        parts = [k[0] if isinstance(k, tuple) else k for k in unknown[:1]] + unknown[1:]
        if "" in parts or list(map(str.strip, parts)) != parts:
            return list(_careful([keys[0][0], *keys[1:]]))
        return keys


class Pool:
    """Byte strings by number, joined by array operations."""

    def __init__(self, values: list[bytes]):
        self.size = np.array([len(x) for x in values], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(values), np.uint8)

    def join(self, numbers: np.ndarray, starts: list[int]) -> list[bytes]:
        """The joined strings of numbers[starts[0]:starts[1]], numbers[starts[1]:starts[2]], ..., up to the end."""
        size = self.size[numbers]
        ends = np.concatenate(([0], np.cumsum(size)))
        parts = []
        cuts = [0]
        while cuts[-1] < len(numbers):  # about PART bytes at a time
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + PART, "right")) - 1))
        for a, b in zip(cuts, cuts[1:]):
            jump = self.at[numbers[a:b]] - (ends[a:b] - ends[a])
            parts.append(self.data[np.arange(int(ends[b] - ends[a])) + np.repeat(jump, size[a:b])].tobytes())
        whole = b"".join(parts)
        edges = ends[np.append(starts, len(numbers))].tolist()
        return [whole[a:b] for a, b in zip(edges, edges[1:])]


_CODECS: dict = {}


def codec(path: str, pattern: str, most: int = 1_000_000) -> Codec:
    """One codec for each rank file in each Python worker."""
    if (path, pattern, most) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, pattern, most] = Codec(read_ranks(path), pattern, most)
    return _CODECS[path, pattern, most]


class Digests:
    def __init__(self, path: str, pattern: str, ids: bool = False, most: int = 1_000_000):
        self.path, self.pattern, self.ids, self.most = path, pattern, ids, most

    def __call__(self, texts: list) -> dict:
        import pyarrow as pa

        c = codec(self.path, self.pattern, self.most)
        packed = c.packed([t.decode("utf-8", "replace") for t in texts])
        n = np.array([len(p) // 4 for p in packed], np.int64)
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        starts = np.cumsum(n) - n
        out = {
            "n_tokens": n,
            "ids_sha256": [hashlib.sha256(x[:-1]).hexdigest() for x in c.names.join(ids, starts)],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in c.words.join(ids, starts)],
        }
        if self.ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids, pa.int32()))
        return out


def bpe_roundtrip(docs: DataFrame, path: str, pattern: str, ids: bool = False, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), most: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: id, ``keep``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids as an array.
    ``most``: parts of texts that a worker remembers (about 250 bytes each), which changes no result.
    Null and empty texts have no ids; very long texts are encoded whole; repeated rows get repeated results; an empty table
    gives no rows; columns outside ``keep`` are not read, and a name of ``keep`` that the result uses itself is an error."""
    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return map_texts(docs, Digests(path, pattern, ids, most), schema, id_col, text_col, keep)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return bpe_roundtrip(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
