"""Benchmark decontamination under edit distance.

A document leaks an item if part of it is within ``share`` of the item's length in edits. An item is cut into more pieces
than it may have edits, so one piece at least is in the document as it is. The same holds for groups of pieces: one of w
pieces has at most w - 1 edits in it, and within it one of its pairs has one edit at most. So pieces are looked up at each
byte of the document, then the other piece of the pair and a node of up to 64 bytes must be near; what is left is verified
exactly by bit-parallel edit distance. No step loses a leak. Both sides are compared in lower case (A-Z), with runs of
ASCII white space as one space, as UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import append_texts, map_texts, table

SHARE, RECALL = 0.2, 0.99
#: Bytes of benchmark text that one pass over the documents handles.
ITEM_BYTES = 4_000_000
#: Bytes of a node at most; bytes of text, hits of seeds and nodes that are handled at once.
NODE, BYTES, HITS, PROBES, WINDOWS = 64, 1 << 16, 1 << 17, 1 << 16, 4096
#: Pairs whose distances are computed in step.
PAIRS = 1024
#: Masks of the lowest bytes of eight, by their number.
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def plain(text: bytes) -> bytes:
    return b" ".join(text.translate(_LOWER).split())


def cuts(n: int, slack: int) -> list[int]:
    """Where an item of n bytes is cut: more pieces than edits, in pairs; one piece where no edit is allowed."""
    k = slack + 1 + (slack + 1) % 2 if slack else 1
    return [n * j // k for j in range(k + 1)]


def eights(buf: np.ndarray) -> np.ndarray:
    """At each position the eight bytes from there on, the first one lowest."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,)).copy()


def within_one(text: np.ndarray, item: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the first n (7 at most) of eight bytes of an item become a start of the text's eight by one edit or none."""
    diff = text ^ item
    same = np.minimum(np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1)) >> 3, n)  # bytes before the first difference
    left, at = n - same, same.astype(np.uint64) << np.uint64(3)
    more = np.minimum(at + np.uint64(8), np.uint64(56))
    rest, fewer = LOW[left], LOW[np.maximum(left, 1) - 1]
    further, item_further = text >> more, item >> more
    return ((further ^ item_further) & fewer == 0) | ((further ^ (item >> at)) & rest == 0) | (((text >> at) ^ item_further) & fewer == 0)


def distances(items: list[bytes], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each item and its text: the edits to the nearest part of the text, and the first end of such a part.

    Myers' bit-parallel columns in words of 64 rows, for all pairs in step: a word hands the change along its last row to
    the next word. A part may begin anywhere, at no cost.
    """
    n, one = len(items), np.uint64(1)
    m = np.array([len(x) for x in items])
    words = -(-int(m.max(initial=1)) // 64)
    kinds, which = {}, []
    for x in items:
        which.append(kinds.setdefault(x, len(kinds)))
    masks = np.zeros((len(kinds), 256, words), np.uint64)
    for x, k in kinds.items():
        i = np.arange(len(x))
        np.bitwise_or.at(masks, (k, np.frombuffer(x, np.uint8), i >> 6), one << (i & 63).astype(np.uint64))
    which, last, bit = np.array(which), (m - 1) >> 6, ((m - 1) & 63).astype(np.uint64)
    size = np.array([len(t) for t in texts])
    by = np.argsort(-size, kind="stable")  # texts that end go from the back
    rows = np.zeros((n, int(size.max(initial=0))), np.uint8)
    for r, k in enumerate(by.tolist()):
        rows[r, : size[k]] = np.frombuffer(texts[k], np.uint8)
    which, last, bit, size = which[by], last[by], bit[by], size[by]
    pv, mv = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    score = m[by].copy()
    best, end = score.copy(), np.zeros(n, np.int64)
    for j in range(rows.shape[1]):
        live = int(np.searchsorted(-size, -j))  # sizes above j
        eqs = masks[which[:live], rows[:live, j]]
        up = down = np.zeros(live, np.uint64)  # what the word above hands on
        for w in range(words):
            eq, p, v = eqs[:, w], pv[w, :live], mv[w, :live]
            xv = eq | v
            eq = eq | down
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = v | ~(xh | p), p & xh
            here = last[:live] == w
            score[:live] += np.where(here, (ph >> bit[:live] & one).astype(np.int64) - (mh >> bit[:live] & one).astype(np.int64), 0)
            next_up, next_down = ph >> np.uint64(63), mh >> np.uint64(63)
            ph, mh = ph << one | up, mh << one | down
            pv[w, :live], mv[w, :live] = mh | ~(xv | ph), ph & xv
            up, down = next_up, next_down
        better = score[:live] < best[:live]
        best[:live] = np.where(better, score[:live], best[:live])
        end[:live] = np.where(better, j + 1, end[:live])
    out = np.empty(n, np.int64), np.empty(n, np.int64)
    out[0][by], out[1][by] = best, end
    return out


def keep(found: list[dict], item_id: int, edits: int, end: int) -> None:
    """Adds an item to a text's list, or improves its entry."""
    old = next((x for x in found if x["item_id"] == item_id), None)
    if old is None:
        found.append({"item_id": item_id, "edits": edits, "end": end})
    elif (edits, end) < (old["edits"], old["end"]):
        old.update(edits=edits, end=end)


class Matcher:
    """Finds items in batches of texts. Only the items are sent to the executors; tables are built there.

    The search is complete whatever ``recall`` asks for; the least recall is a caller's demand, not a permission to lose.
    """

    def __init__(self, items: list[tuple[int, bytes]], share: float, recall: float):
        if not 0 <= share < 0.5:
            raise ValueError("share must be at least 0 and below 0.5")
        self.items, self.share, self.recall, self.made = items, share, recall, False

    def __getstate__(self):
        return {"items": self.items, "share": self.share, "recall": self.recall, "made": False}

    def build(self) -> None:
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.slack = (self.size * self.share).astype(np.int64)
        leaves: dict = {}  # (bytes of the seed, whether the twin lies behind it): seed, item, offset, twin, its bytes, node
        nodes = []  # item, start, bytes, edits
        for i, (_, t) in enumerate(self.items):
            at = cuts(len(t), int(self.slack[i]))
            if len(at) == 2:
                nodes.append((i, 0, min(len(t), NODE), 0))
                leaves.setdefault((min(len(t), 8), True), []).append((t[:8], i, 0, b"", 0, len(nodes) - 1))
                continue
            j = 0
            while j < len(at) - 1:
                end = j + 2
                while end < len(at) - 1 and at[end + 2] - at[j] <= NODE:
                    end += 2
                a, b, edits = at[j], at[end], end - j - 1
                if b - a > NODE:  # one pair of long pieces: what lies around its middle
                    a, b = max(a, at[j + 1] - NODE // 2), min(b, at[j + 1] + NODE // 2)
                nodes.append((i, a, b - a, edits))
                for x in range(j, end, 2):
                    lo, mid, hi = at[x : x + 3]
                    seed, twin = t[max(lo, mid - 8) : mid], t[mid : min(hi, mid + 7)]
                    leaves.setdefault((len(seed), True), []).append((seed, i, mid - len(seed), twin, len(twin), len(nodes) - 1))
                    seed, twin = t[mid : min(hi, mid + 8)], t[max(lo, mid - 7) : mid][::-1]
                    leaves.setdefault((len(seed), False), []).append((seed, i, mid, twin, len(twin), len(nodes) - 1))
                j = end
        self.nodes = np.array(nodes, np.int64).reshape(-1, 4).T
        self.masks = np.zeros((len(nodes), 256), np.uint64)
        for k, (i, a, n, _) in enumerate(nodes):  # the last row is the highest bit; rows below the first match always
            row = np.arange(64 - n, 64, dtype=np.uint64)
            self.masks[k] = np.uint64((1 << 64 - n) - 1)
            np.bitwise_or.at(self.masks[k], np.frombuffer(self.items[i][1], np.uint8)[a : a + n], np.uint64(1) << row)
        self.leaves = {}
        for (q, behind), rows in leaves.items():
            seed, item, off, twin, n, node = zip(*rows)
            seed, twin = (np.array([int.from_bytes(x, "little") for x in xs], np.uint64) for xs in (seed, twin))
            bits = max(16, len(rows).bit_length() + 4)
            slot = self.slots(seed, bits)
            by = np.argsort(slot, kind="stable")
            count = np.bincount(slot, minlength=1 << bits).astype(np.int32)
            first = (np.cumsum(count) - count).astype(np.int32)
            self.leaves[q, behind] = (bits, count, first, seed[by], twin[by], np.array(n, np.uint8)[by], *(np.array(x, np.int64)[by] for x in (item, off, node)))
        self.made = True

    @staticmethod
    def slots(seeds: np.ndarray, bits: int) -> np.ndarray:
        return ((seeds * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def proposals(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, start in the text) of the windows that seeds propose, distinct and in order."""
        pad = np.zeros(4 * NODE, np.uint8)
        buf = np.concatenate((pad, buf, pad))
        word, found, waiting, size = eights(buf), [], [], 0
        for lo in range(len(pad), len(buf) - len(pad), BYTES):
            part = word[lo : min(lo + BYTES, len(buf) - len(pad))]
            for (q, behind), (bits, count, first, seed, twin, n, item, off, node) in self.leaves.items():
                x = part & LOW[q]
                slot = self.slots(x, bits)
                times = count[slot]
                at = np.flatnonzero(times)
                # seeds that many items share are handled in parts
                upto = np.cumsum(times[at], dtype=np.int64)
                ends = np.unique(np.append(np.searchsorted(upto, np.arange(HITS, int(upto[-1]) if len(upto) else 0, HITS)), len(at)))
                for a, b in zip([0, *ends.tolist()], ends.tolist()):
                    where = at[a:b]
                    m = times[where]
                    leaf = np.repeat(first[slot[where]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                    where = np.repeat(where, m)
                    hit = seed[leaf] == x[where]
                    near = word[where + (lo + q)] if behind else word[where + (lo - 8)].byteswap()
                    hit &= within_one(near, twin[leaf], n[leaf])
                    leaf, where = leaf[hit], where[hit] + lo
                    waiting.append(np.stack((where, item[leaf], off[leaf], node[leaf])))
                    size += len(leaf)
            if size >= PROBES:
                found.append(self.near(buf, np.concatenate(waiting, 1)))
                waiting, size = [], 0
        if waiting:
            found.append(self.near(buf, np.concatenate(waiting, 1)))
        at, item, off = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
        at = at - len(pad)
        text = np.searchsorted(starts, at, "right") - 1
        rows = np.unique(np.stack((text, item, at - off - starts[text]), 1), axis=0)
        rows = rows[rows[:, 0] < len(starts) - 1]
        return rows[:, 0], rows[:, 1], rows[:, 2]

    def near(self, buf: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(position, item, offset) of the rows (and their node) whose node is in the text around them within its edits."""
        _, a, n, edits = self.nodes[:, rows[3]]
        start = rows[0] - rows[2] + a - edits
        by = np.lexsort((start, n + 2 * edits))
        rows, start, n, edits = rows[:, by], start[by], n[by], edits[by]
        flat, good = self.masks.ravel(), np.zeros(len(start), bool)
        for lo in range(0, len(start), WINDOWS):
            part = slice(lo, lo + WINDOWS)
            base, at, size = rows[3, part] * 256, start[part], n[part]
            pv, mv = ~np.uint64(0) << (64 - size).astype(np.uint64), np.zeros(len(at), np.uint64)
            score = size.copy()
            best = score.copy()
            for j in range(int((size + 2 * edits[part]).max())):
                eq = flat[base + buf[at + j]]
                xv = eq | mv
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                score += (ph >> np.uint64(63)).view(np.int64)
                score -= (mh >> np.uint64(63)).view(np.int64)
                np.minimum(best, score, out=best)
                ph, mh = ph << np.uint64(1), mh << np.uint64(1)
                pv, mv = mh | ~(xv | ph), ph & xv
            good[part] = best <= edits[part]
        return rows[:3, good]

    def find(self, raw: list[bytes]) -> list[list[dict]]:
        """For each text the items it leaks: item_id, edits, and the end of the nearest part in the normalised text."""
        if not self.made:
            self.build()
        texts = [plain(t) for t in raw]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        text, item, start = self.proposals(np.frombuffer(b"\0".join([*texts, b""]), np.uint8), starts)
        out: list[list[dict]] = [[] for _ in raw]
        if not len(text):
            return out
        # windows of one item that are within the slack of each other are verified together
        apart = np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > self.slack[item[1:]])))
        first = np.flatnonzero(apart)
        last = np.append(first[1:], len(text)) - 1
        pairs = []
        for a, b in zip(first.tolist(), last.tolist()):
            d, k = int(text[a]), int(item[a])
            slack, needle = int(self.slack[k]), self.items[k][1]
            lo = max(0, int(start[a]) - slack)
            part = texts[d][lo : int(start[b]) + len(needle) + slack]
            at = part.find(needle)
            if at >= 0:
                keep(out[d], self.items[k][0], 0, lo + at + len(needle))
            else:
                pairs.append((d, k, lo, part))
        pairs.sort(key=lambda x: len(self.items[x[1]][1]))
        for lo in range(0, len(pairs), PAIRS):
            group = pairs[lo : lo + PAIRS]
            edits, ends = distances([self.items[k][1] for _, k, *_ in group], [part for *_, part in group])
            for (d, k, at, _), e, end in zip(group, edits.tolist(), ends.tolist()):
                if e <= self.slack[k]:
                    keep(out[d], self.items[k][0], e, at + end)
        return out

    def __call__(self, raw: list) -> dict:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64()), ("end", pa.int64())]))
        return {"leaks": pa.array(self.find(raw), kind)}


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = ITEM_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's items, normalised, in blocks of bounded size. Null ids and items without words are left out."""
    block, size = [], 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        t = plain(bytes(r["t"]))
        if t:
            block.append((r["i"], t))
            size += len(t)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


KIND = "array<struct<item_id:bigint,edits:bigint,end:bigint>>"


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each row of ``docs`` and item that it leaks: id, item_id, edits, end (of the nearest part, in bytes of the
    normalised text). Null and empty texts leak nothing; items of equal text are found each; repeated rows get repeated
    results; empty tables give no rows. The documents are read once for each block of items."""
    out = None
    for block in item_blocks(items, item_id, item_text):
        part = map_texts(docs, Matcher(block, share, recall), f"leaks {KIND}", id_col, text_col).select(id_col, F.inline("leaks"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.select(id_col).limit(0).select(id_col, *[F.lit(None).cast("bigint").alias(c) for c in ("item_id", "edits", "end")])


def clean(docs: DataFrame, items: DataFrame, share: float = SHARE, recall: float = RECALL, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that leak an item; all its columns, unchanged, whatever their names."""
    names = docs.columns
    for block in item_blocks(items):
        found, name = append_texts(docs, Matcher(block, share, recall), {"leaks": KIND}, text_col)
        docs = found.filter(F.size(F.col(name["leaks"])) == 0).select(*[F.col(f"`{c}`") for c in names])
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
