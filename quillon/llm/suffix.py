"""Removal of passages that repeat across documents, by suffix arrays.

A byte goes if a window of ``span`` bytes that covers it also starts in a document with a smaller id.

1. Route. Every window has a minimiser: the k-gram of least hash in it. Equal windows have equal minimisers, so only
   minimisers that two documents share can lie in a repeated window. Blocks send their minimisers' hashes to ranges of
   hash values and hear back which are shared.
2. Decide. Blocks send the text around shared minimisers (each distinct text once) to the range of the minimiser, a shard.
   Windows of a minimiser that is met more than HOT times are sent one by one to the range of a hash of their own bytes, so
   that no minimiser fills a shard. A shard builds suffix arrays over at most PART bytes each by Larsson-Sadakane refinement,
   gets the common prefixes of neighbours by Kasai's rule (in text order, each begins where the one before it left off, less
   one byte), which group equal windows, and merges its arrays by binary search. Each window learns the least document id
   that holds it.
3. Remove. Blocks hear those ids and cut what an earlier document has.

Nothing is sampled and no partner is capped: whatever a shard decides, it decides on all windows that have its minimisers.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import release, shared_dir, stored, table, trim
from .blocks import Blocks, read_block
from .files import NewFile, open_file

SPAN, GRAM = 50, 24
#: Bytes that are hashed at once, and bytes of one suffix array.
SUB, PART = 1 << 19, 1 << 20
#: Occurrences of a minimiser from which its windows are dealt by their own bytes; rows of a block.
HOT, ROWS = 1 << 16, 2048
#: Lanes in which common prefixes are found in step.
LANES = 2048
_LOW = (1 << 23) - 1
LAST = (1 << 63) - 1


def pack(*arrays: np.ndarray) -> bytes:
    raw = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays) + b"".join(a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 1 + 10 * raw[0]
    for k in range(raw[0]):
        kind, n = struct.unpack_from("<2sQ", raw, 1 + 10 * k)
        out.append(np.frombuffer(raw, kind.decode(), n, at))
        at += out[-1].nbytes
    return out


def planes(sorted_hashes: np.ndarray) -> np.ndarray:
    """Sorted 64-bit values as byte planes of their differences, which compress."""
    return np.diff(sorted_hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.ravel()


def unplanes(data: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(data.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def segments(texts: list[bytes], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, document, offset in the document, starts in the buffer plus its end) of parts of the texts. Parts of a long
    text overlap by span - 1 bytes, so that every window lies in exactly one part."""
    parts: list = []
    size = 0

    def flush():
        starts = np.cumsum([0] + [len(p[2]) for p in parts])
        return np.frombuffer(b"".join(p[2] for p in parts), np.uint8), np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), starts

    for d, t in enumerate(texts):
        for at in range(0, max(1, len(t) - span + 1), SUB):
            part = t[at : at + SUB + span - 1]
            if len(part) < span:
                continue
            if parts and size + len(part) > SUB:
                yield flush()
                parts, size = [], 0
            parts.append((d, at, part))
            size += len(part)
    if parts:
        yield flush()


def minimisers(buf: np.ndarray, starts: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of the minimisers in a buffer: runs of windows that have the same one."""
    n, width = len(buf), span - gram + 1
    h, size = buf.astype(np.uint64) + np.uint64(1), 1
    base, powers = 0x9E3779B97F4A7C15, {}
    steps = []
    while 2 * size <= gram:  # hashes of 1, 2, 4, ... bytes
        powers[size] = h
        h = h[:-size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
        size *= 2
    steps, have = h, size
    while have < gram:  # and of the rest, from the right
        more = max(s for s in powers if s <= gram - have) if size > gram - have else size
        tail = powers.get(more, h)
        m = n - have - more + 1
        steps = steps[:m] * np.uint64(pow(base, more, 1 << 64)) + tail[have : have + m]
        have += more
    x = steps
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    key = (x & np.uint64(~_LOW & (1 << 64) - 1)) | np.arange(len(x), dtype=np.uint64)
    low, have = key, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(key) - width + 1], low[width - have :])
    inside = np.ones(len(low), bool)
    for e in starts[1:].tolist():
        inside[max(0, e - span + 1) : e] = False
    s = np.flatnonzero(inside)
    if not len(s):
        return np.zeros(0, np.uint64), s, s
    at = (low[s] & np.uint64(_LOW)).astype(np.int64)
    change = np.flatnonzero((at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)) + 1
    first = np.concatenate(([0], change))
    least = x[at[first]] * np.uint64(0x9E3779B97F4A7C15)  # least hashes are small: mixed again, they fill all ranges alike
    return least ^ least >> np.uint64(32), s[first], s[np.concatenate((change, [len(s)])) - 1]


def suffix_array(buf: np.ndarray) -> np.ndarray:
    """All suffixes in order; a suffix that another begins with comes first.

    Larsson-Sadakane: suffixes are sorted by 7 bytes, then groups that are still equal are sorted by the rank of the
    suffix ``h`` bytes on, which doubles the sorted length; suffixes that are alone in their group are not touched again.
    """
    n = len(buf)
    pad = np.concatenate((buf, np.zeros(8, np.uint8)))
    key = pad[:-1].astype(np.uint64) << np.uint64(8) | pad[1:]
    key = key[:-2] << np.uint64(16) | key[2:]
    key = (key[:-4] << np.uint64(32) | key[4:])[:n]
    key = (key & np.uint64(~255 & (1 << 64) - 1)) | np.minimum(n - np.arange(n), 7).astype(np.uint64)  # how many bytes are there
    order = np.argsort(key)
    rank = _ranks(order, key[order])
    del key, pad
    h = 7
    while True:
        in_order = rank[order]
        alone = np.ones(n, bool)
        alone[1:] &= in_order[1:] != in_order[:-1]
        alone[:-1] &= in_order[1:] != in_order[:-1]
        where = np.flatnonzero(~alone)
        if not len(where):
            return order
        some = order[where]
        nxt = np.where(some + h < n, rank[np.minimum(some + h, n - 1)] + 1, 0)
        both = rank[some].astype(np.uint64) * np.uint64(n + 1) + nxt.astype(np.uint64)
        by = np.argsort(both)
        order[where], both = some[by], both[by]
        new = np.concatenate(([True], both[1:] != both[:-1]))
        rank[order[where]] = where[np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))]
        h *= 2


def _ranks(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return rank


def eights(buf: np.ndarray) -> np.ndarray:
    """At each position the eight bytes from there on, the first one lowest; zeros follow the end. No copy is made."""
    pad = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf) + 1,), "<u8", pad, strides=(1,))


def common_prefixes(buf: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in the order, the common prefix with the place before, up to ``depth`` bytes.

    Kasai: in text order, a suffix shares with its predecessor in the array at least one byte less than the suffix before
    it did with its own. The text is cut into lanes that are walked in step; each carries its length along.
    """
    n = len(order)
    size = np.zeros(n, np.int64)
    if n < 2:
        return size
    word, before = eights(buf), np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    step = -(-n // LANES)
    first = np.arange(0, n, step)
    carried = np.zeros(len(first), np.int64)
    for s in range(step):
        i = first + s
        if i[-1] >= n:
            i = i[:-1]
        j = before[i]
        h = np.where(j >= 0, np.maximum(carried[: len(i)] - 1, 0), 0)
        live = np.flatnonzero(j >= 0)
        while len(live):
            a, b, have = i[live], j[live], h[live]
            room = np.minimum(n - np.maximum(a, b), depth) - have
            differ = word[np.minimum(a + have, n)] ^ word[np.minimum(b + have, n)]
            same = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3  # 8 where none differs
            got = np.minimum(same, np.maximum(room, 0))
            h[live] = have + got
            live = live[(got == 8) & (room > 8)]
        size[i] = carried[: len(i)] = h
    return size[order]


def least_ids(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], span: int) -> list[np.ndarray]:
    """For each part (bytes, window starts, document of each window): the least document that has each window's bytes,
    in any part. Parts have their own suffix arrays, whose distinct windows are merged in pairs by binary search."""
    groups, texts, lows = [], [], []
    for buf, starts, docs in parts:
        order = suffix_array(buf)
        is_start = np.full(len(buf), -1, np.int64)
        is_start[starts] = np.arange(len(starts))
        new = common_prefixes(buf, order, span) < span
        which = is_start[order]
        # a place that begins no window is left out, and hands a change of group on to the next that does
        group = np.cumsum(new)[which >= 0]
        order, which = order[which >= 0], which[which >= 0]
        at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else group
        lows.append(np.minimum.reduceat(docs[which], at) if len(at) else np.zeros(0, np.int64))
        texts.append(np.lib.stride_tricks.sliding_window_view(buf, span)[order[at]].view(f"S{span}").ravel() if len(at) else np.zeros(0, f"S{span}"))
        own = np.empty(len(starts), np.int64)
        own[which] = np.cumsum(np.concatenate(([0], group[1:] != group[:-1]))) if len(group) else group
        groups.append(own)
    if len(parts) > 1:
        every, low = _merged(list(zip(texts, lows)))
        lows = [low[np.searchsorted(every, t)] for t in texts]
    return [low[own] for low, own in zip(lows, groups)]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct windows and their least documents, of sorted parts: neighbours are merged until one is left."""
    while len(parts) > 1:
        out = parts[len(parts) & ~1 :]
        for (a, x), (b, y) in zip(parts[::2], parts[1::2]):
            at = np.searchsorted(a, b)
            hit = (a[np.minimum(at, len(a) - 1)] == b) if len(a) else np.zeros(len(b), bool)
            x = x.copy()
            x[at[hit]] = np.minimum(x[at[hit]], y[hit])
            out.append((np.insert(a, at[~hit], b[~hit]), np.insert(x, at[~hit], y[~hit])))
        parts = out
    return parts[0]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([LAST if x is None else x for x in batch.column("__id").to_pylist()], np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("__text").to_pylist()]


def block_hashes(file: str, span: int, shift: int) -> Iterator[tuple[int, bytes]]:
    """(range, its minimisers' hashes in the block, how often each is met, whether two documents of the block have it)."""
    hashes, docs, times, n = [], [], [], 0
    for batch in read_block(file, ["__text"]):
        for buf, doc, _, starts in segments(_texts(batch), span):
            h, lo, _ = minimisers(buf, starts, span)
            hashes.append(h)
            docs.append(n + doc[np.searchsorted(starts, lo, "right") - 1])
            times.append(np.ones(len(h), np.int64))
        n += batch.num_rows
        if len(hashes) >= 32:  # keep the distinct pairs only
            hashes, docs, times = ([x] for x in _distinct(np.concatenate(hashes), np.concatenate(docs), np.concatenate(times)))
    if not hashes:
        return
    h, d, c = _distinct(np.concatenate(hashes), np.concatenate(docs), np.concatenate(times))
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    h, several, c = h[at], np.diff(np.append(at, len(d))) > 1, np.add.reduceat(c, at)
    edges = np.flatnonzero(np.diff(h >> np.uint64(shift))) + 1 if shift < 64 else np.zeros(0, np.int64)
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(h)]):
        yield int(h[a] >> np.uint64(shift)) if shift < 64 else 0, pack(planes(h[a:b]), np.packbits(several[a:b]), c[a:b].astype(np.uint32))


def _distinct(h: np.ndarray, d: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.lexsort((d, h))
    h, d = h[by], d[by]
    at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
    return h[at], d[at], np.add.reduceat(c[by], at) if len(at) else c


def shared_hashes(rows: list[tuple[int, bytes]], hot: int) -> Iterator[tuple[int, bytes]]:
    """(block, its hashes that another document has too, which of them are hot) from the rows (block, hashes) of one range."""
    got = []
    for block, data in rows:
        p, several, times = unpack(data)
        h = unplanes(p)
        got.append((block, h, np.unpackbits(several)[: len(h)].astype(bool), times))
    every = np.concatenate([h for _, h, *_ in got])
    by = np.argsort(every)
    every = every[by]
    at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    copies = np.diff(np.append(at, len(every))) + np.maximum.reduceat(np.concatenate([s for *_, s, _ in got])[by].astype(np.int64), at)
    times = np.add.reduceat(np.concatenate([t for *_, t in got])[by].astype(np.int64), at)
    shared, many = every[at][copies > 1], times[copies > 1] > hot
    for block, h, *_ in got:
        both = h[_within(shared, h)]
        if len(both):
            yield block, pack(planes(both), np.packbits(many[np.searchsorted(shared, both)]))


def _within(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def mixed(word: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each part of at least 8 bytes, from the eights at its positions."""
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, int(size.max(initial=0)) - 7, 8):
        far = np.where(size >= k + 8, at + k, at + size - 8)
        h = (h ^ word[far]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    h = (h ^ word[at + size - 8]) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def kinds_of(word: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each part of at least 8 bytes, and a part of each kind. Parts of one kind are equal, which is verified;
    parts that only share their hash with others are kinds of their own, so equal parts may rarely be of two kinds."""
    key = mixed(word, at, size)
    by = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[by][1:] != key[by][:-1])) if len(by) else np.zeros(0, bool)
    group = np.empty(len(by), np.int64)
    group[by] = np.cumsum(new) - 1
    some = by[new]
    like = some[group]
    same = size == size[like]
    for k in range(0, int(size.max(initial=0)) - 7, 8):
        far = np.minimum(k, size - 8)
        same &= word[at + far] == word[at[like] + np.minimum(far, size[like] - 8)]
    same &= word[at + size - 8] == word[at[like] + size[like] - 8]
    if len(odd := np.flatnonzero(~same)):
        group[odd] = len(some) + np.arange(len(odd))
        some = np.concatenate((some, odd))
    return group, some


def _least(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, LAST, np.int64)
    np.minimum.at(out, group, values)
    return out


def block_fragments(file: str, shared: np.ndarray, many: np.ndarray, span: int, shift: int) -> Iterator[tuple[int, bytes]]:
    """(range, its distinct fragments in the block), and as range -1 where in the block each fragment is.

    A fragment is the text of a run of windows with one minimiser, or one window where the minimiser is hot; of equal
    fragments the least document is sent along.
    """
    parts, docs, offsets, places, sizes, keys, owners = [], [], [], [], [], [], []
    n = total = 0
    for batch in read_block(file, ["__id", "__text"]):
        ids = _ids(batch)
        for buf, doc, base, starts in segments(_texts(batch), span):
            h, lo, hi = minimisers(buf, starts, span)
            at = np.flatnonzero(_within(shared, h))
            if not len(at):
                continue
            h, lo, hi = h[at], lo[at], hi[at]
            hot = many[np.searchsorted(shared, h)]
            if hot.any():
                windows = _ranges(lo[hot], hi[hot] - lo[hot] + 1)
                own = mixed(eights(buf), windows, np.full(len(windows), span))
                h, lo, hi = np.concatenate((h[~hot], own)), np.concatenate((lo[~hot], windows)), np.concatenate((hi[~hot], windows))
            seg = np.searchsorted(starts, lo, "right") - 1
            parts.append(buf)
            docs.append((n + doc[seg]).astype(np.uint32))
            offsets.append(base[seg] + lo - starts[seg])
            places.append(total + lo)
            sizes.append(hi - lo + span)
            keys.append(h)
            owners.append(ids[doc[seg]])
            total += len(buf)
        n += batch.num_rows
    if not parts:
        return
    whole, place, size, key, owner = (np.concatenate(x) for x in (parts, places, sizes, keys, owners))
    parts, places, sizes, keys, owners = [], [], [], [], []
    kind, some = kinds_of(eights(whole), place, size)
    yield -1, pack(np.concatenate(docs), np.concatenate(offsets), kind.astype(np.uint32))
    low, key, place, size = _least(kind, owner, len(some)), key[some], place[some], size[some]
    by = np.argsort(key, kind="stable")
    to = (key[by] >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(by), np.int64)
    edges = np.flatnonzero(np.diff(to)) + 1
    for part, a in zip(np.split(by, edges), [0, *edges.tolist()]):
        yield int(to[a]), pack(part.astype(np.uint32), low[part], size[part].astype(np.uint32), key[part], whole[_ranges(place[part], size[part])])


def shard_windows(rows: list[tuple[int, bytes]], span: int, part_bytes: int = PART) -> Iterator[tuple[int, bytes]]:
    """(block, fragments and the least document of each of their windows) from the rows (block, fragments) of one range.

    Equal fragments of several blocks are one. A fragment that is alone under its minimiser has no window in common with
    another, since equal windows have one minimiser; the others go to suffix arrays.
    """
    got = [(block, *unpack(data)) for block, data in rows]
    size = np.concatenate([x[3] for x in got]).astype(np.int64)
    whole, key = np.concatenate([x[5] for x in got]), np.concatenate([x[4] for x in got])
    place = np.cumsum(size) - size
    mine, some = kinds_of(eights(whole), place, size)
    low = _least(mine, np.concatenate([x[2] for x in got]), len(some))
    at = np.cumsum([0] + [len(x[1]) for x in got])
    got = [(x[0], x[1], x[3]) for x in got]
    size, place, key = size[some], place[some], key[some]
    count = size - span + 1
    begin = np.cumsum(count) - count
    answer = np.repeat(low, count)
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[inverse] > 1)
    several = several[np.argsort(inverse[several], kind="stable")]
    # equal windows have one key: whole runs of keys are decided together, as many as fit into one suffix array
    ends = np.cumsum(size[several])
    runs, start, here = [], 0, 0
    for e in np.append(np.flatnonzero(np.diff(inverse[several])) + 1, len(several)).tolist():
        if here > start and ends[e - 1] - (ends[start - 1] if start else 0) > part_bytes:
            runs.append((start, here))
            start = here
        here = e
    if here > start:
        runs.append((start, here))
    for a, b in runs:
        together, made = several[a:b], []
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(size[together]), np.arange(part_bytes, int(size[together].sum()), part_bytes)), [0, len(together)]))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = together[x:y]
            first = np.cumsum(size[part]) - size[part]
            made.append((whole[_ranges(place[part], size[part])], _ranges(first, count[part]), np.repeat(low[part], count[part])))
        for x, y, got_low in zip(cuts[:-1].tolist(), cuts[1:].tolist(), least_ids(made, span)):
            answer[_ranges(begin[together[x:y]], count[together[x:y]])] = got_low
    for (block, ids, sizes), a, b in zip(got, at[:-1].tolist(), at[1:].tolist()):
        which = mine[a:b]
        yield block, pack(ids, sizes, answer[_ranges(begin[which], count[which])])


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] values), first[1], ..."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def block_kept(file: str, occurrences: list[np.ndarray] | None, answers: list[list[np.ndarray]], span: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[np.ndarray], list[bytes]]]:
    """(batch, texts, removed spans as (from, to) rows, kept bytes) of the block's rows, in their order."""
    if occurrences is None:
        docs = offsets = kinds = np.zeros(0, np.int64)
    else:
        docs, offsets, kinds = (x.astype(np.int64) for x in occurrences)
    by = np.argsort(docs, kind="stable")
    docs, offsets, kinds = docs[by], offsets[by], kinds[by]
    total = sum(len(a[0]) for a in answers)
    begin, count = np.zeros(total, np.int64), np.zeros(total, np.int64)
    lows, at = [], 0
    for kind, size, low in answers:
        n = size.astype(np.int64) - span + 1
        begin[kind], count[kind] = at + np.cumsum(n) - n, n
        lows.append(low)
        at += len(low)
    low = np.concatenate(lows) if lows else np.zeros(0, np.int64)
    row = 0
    for batch in read_block(file):
        ids, texts = _ids(batch), _texts(batch)
        edge = np.searchsorted(docs, np.arange(row, row + len(texts) + 1)).tolist()
        removed, kept = [], []
        for i, t in enumerate(texts):
            a, b = edge[i], edge[i + 1]
            spans = np.zeros((0, 2), np.int64)
            if a < b:
                n = count[kinds[a:b]]
                local = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                gone = low[np.repeat(begin[kinds[a:b]], n) + local] < ids[i]
                s = (np.repeat(offsets[a:b], n) + local)[gone]
                if len(s):
                    change = np.zeros(len(t) + 1, np.int32)
                    np.add.at(change, s, 1)
                    np.add.at(change, s + span, -1)
                    cover = np.concatenate(([False], np.cumsum(change[:-1]) > 0, [False]))
                    spans = np.flatnonzero(cover[1:] != cover[:-1]).reshape(-1, 2)
            removed.append(spans)
            if len(spans):
                cuts = [0, *spans.ravel().tolist(), len(t)]
                t = b"".join(t[x:y] for x, y in zip(cuts[::2], cuts[1::2]))
            kept.append(t)
        row += len(texts)
        yield batch, texts, removed, kept


def deduplicated(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), texts: bool = True, spans: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``keep``, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) and, if
    asked for, text (what remains, without characters that a cut has split) and the removed spans. Windows never cross
    documents, null texts count as empty, very long texts are cut as any other, rows with equal ids do not cut each other.
    Rows with a null id are cut by all others and cut none. Ids are integers below 2**63 - 1. An empty table gives no rows.
    Columns outside ``keep`` are not read; a name of ``keep`` that the result uses itself is an error before anything runs.
    """
    spark, where = docs.sparkSession, shared_dir(docs.sparkSession)
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * texts, *["spans"] * spans]
    if len({c.lower() for c in (id_col, *keep, *made, "__id", "__text")}) < len(keep) + len(made) + 3:
        raise ValueError(f"columns of one name in {[id_col, *keep, *made]}")
    src = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("__text"), *[F.col(c) for c in keep])
    blocks = Blocks(src, f"{where}/blocks", ROWS)
    bits = max(3, (len(blocks) - 1).bit_length())
    shift = 64 - bits
    pairs = "target int, block int, payload binary"

    def hashes(batches):
        for batch in batches:
            for r in batch.to_pylist():
                for to, data in block_hashes(r["file"], span, shift):
                    yield _pairs([(to, r["block"], data)])

    sent = blocks.spread().mapInArrow(hashes, pairs)

    def meet(rows: pa.Table) -> pa.Table:
        got = list(shared_hashes(list(zip(rows.column("block").to_pylist(), rows.column("payload").to_pylist())), HOT))
        trim()
        return pa.table({"block": pa.array([b for b, _ in got], pa.int32()), "payload": pa.array([d for _, d in got], pa.binary())})

    shared = stored(sent.groupBy("target").applyInArrow(meet, "block int, payload binary"), f"{where}/shared", 4 << 20)
    del sent
    release(spark)

    def fragments(rows: pa.Table) -> pa.Table:
        file = next(x for x in rows.column("file").to_pylist() if x)
        data = []
        for x in rows.column("payload").to_pylist():
            if x:
                p, many = unpack(x)
                h = unplanes(p)
                data.append((h, np.unpackbits(many)[: len(h)].astype(bool)))
        block = rows.column("block")[0].as_py()
        out = []
        shared_, many_ = (np.concatenate(x) for x in zip(*data)) if data else (None, None)
        by = np.argsort(shared_) if data else None
        for to, x in block_fragments(file, shared_[by], many_[by], span, shift) if data else ():
            if to < 0:
                with NewFile(f"{where}/occurrences/{block}") as side:
                    side.write(x)
            else:
                out.append((to, block, x))
        made = pa.Table.from_batches([_pairs(out)])
        trim()
        return made

    found = blocks.with_rows(shared).repartition(max(1, len(blocks)), "block").groupBy("block").applyInArrow(fragments, pairs)

    def shard(rows: pa.Table) -> pa.Table:
        got = list(shard_windows(list(zip(rows.column("block").to_pylist(), rows.column("payload").to_pylist())), span))
        trim()
        return pa.table({"block": pa.array([b for b, _ in got], pa.int32()), "payload": pa.array([d for _, d in got], pa.binary())})

    rows = blocks.with_rows(found.groupBy("target").applyInArrow(shard, "block int, payload binary"))
    schema = T.StructType([T.StructField(id_col, T.LongType()), *[docs.schema[c] for c in keep], *T._parse_datatype_string("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", text string" * texts + ", spans array<struct<start:bigint,end:bigint>>" * spans).fields])

    def cut(table_: pa.Table) -> pa.Table:
        file = next(x for x in table_.column("file").to_pylist() if x)
        got = [unpack(d) for d in table_.column("payload").to_pylist() if d]
        where_ = None
        if got:  # a block whose fragments were answered has written where they are
            with open_file(f"{where}/occurrences/{table_.column('block')[0].as_py()}") as side:
                where_ = unpack(side.read())
        out = pa.Table.from_batches([_cut(batch, whole, gone, kept, id_col, keep, texts, spans) for batch, whole, gone, kept in block_kept(file, where_, got, span)])
        trim()
        return out

    return rows.repartition(max(1, len(blocks)), "block").groupBy("block").applyInArrow(cut, schema)


def _pairs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    to, block, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(block, pa.int32()), pa.array(data, pa.binary())], names=["target", "block", "payload"])


def _cut(batch: pa.RecordBatch, whole: list, gone: list, kept: list, id_col: str, keep: tuple, texts: bool, spans: bool) -> pa.RecordBatch:
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    cols = {
        id_col: batch.column("__id"), **{c: batch.column(c) for c in keep}, "n_bytes": pa.array([len(t) for t in whole], pa.int64()),
        "n_removed": pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in gone], pa.int64()), "n_spans": pa.array([len(s) for s in gone], pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
    }
    if texts:
        cols["text"] = pa.array([t.decode("utf-8", "ignore") for t in kept], pa.string())
    if spans:
        cols["spans"] = pa.array([[{"start": a, "end": b} for a, b in s.tolist()] for s in gone], span_type)
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


#: The same for DuckDB, by grouping all windows. Texts are hexadecimal; they are cut in chunks first, since a far substring
#: is slow to reach.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, unnest(range(0, greatest(length(h) // 2 - 49, 0), 1000)) AS pos, h FROM d),
k AS (SELECT doc_id, pos, substr(h, (2 * pos + 1)::INT, 2098) AS part FROM c),
w AS (SELECT doc_id, pos + s AS s, substr(part, (2 * s + 1)::INT, 100) AS win FROM (SELECT doc_id, pos, part, unnest(range(0, length(part) // 2 - 49)) AS s FROM k)),
low AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY win) AS least FROM w),
gone AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM low WHERE least < doc_id),
run AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM gone),
span AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM run GROUP BY doc_id, r),
edge AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM span),
cut AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM edge JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), texts=False)
