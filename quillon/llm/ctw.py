"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions. For each decision there is a tree of contexts, the preceding bytes, up to DEPTH of
them. A node's Krichevsky-Trofimov estimate is mixed with its children's weighted estimate, half and half over the block
probabilities of the training data, so that a prediction is an average over all depths. A context that training has not
seen predicts one half, its estimate without data, and enters the mixture with that. A text ends with the byte 255, which
UTF-8 never uses, and begins in a context of such bytes; its score is the log10 probability of its lower-cased bytes and
that end, and its code length is the same in bits for each of these bytes.

Training counts all (DEPTH + 1)-grams of all training texts. Blocks of documents send their distinct grams to shards by
the two latest context bytes; a shard holds the whole subtrees below these. What is above is at most 256 * 255 nodes.
Blocks hear the probability of each of their grams and sum over their documents. No task sees the whole model. Words are
counted in the same way, under their own bytes.
"""

from __future__ import annotations

import zlib
from collections import Counter as WordCounter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import held_fold, shared_dir, stored, table
from .blocks import Blocks, read_block
from .suffix import pack, planes, unpack, unplanes

DEPTH, END = 5, 255
#: Bytes of text whose grams are sorted at once.
SUB = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_HALF = np.log(0.5)


def _log_factorials(n: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, n)
    return np.concatenate(([0.0], np.cumsum(np.log(k)))), np.concatenate(([0.0], np.cumsum(np.log(k - 0.5)))) + 0.5 * np.log(np.pi)


_FULL, _HALVES = _log_factorials()  # log gamma(n + 1), log gamma(n + 1/2)


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""

    def of(n, small, shift):
        return np.where(n < len(small), small[np.minimum(n, len(small) - 1)], _stirling(np.maximum(n, 1) + shift))

    return of(a, _HALVES, 0.5) + of(b, _HALVES, 0.5) - of(a + b, _FULL, 1.0) - np.log(np.pi)


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (depth + 1)-gram of every position, the end included, and each text's first position (with the total at the end).

    A gram has the latest context byte on top, then older ones, and the coded byte at the bottom.
    """
    pad = bytes([END]) * depth
    end = bytes([END])
    buf = np.frombuffer(b"".join([x for t in texts for x in (pad, t.translate(_LOWER), end)]), np.uint8)
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    key = buf[depth:].astype(np.uint64)
    for d in range(1, depth + 1):
        key = key | buf[depth - d : len(buf) - d].astype(np.uint64) << np.uint64(8 * (depth + 1 - d))
    first = np.cumsum(n) - n
    # the positions of a text's padding are left out
    at = np.arange(int(n.sum())) + np.repeat(np.arange(len(texts)) * depth, n)
    return key[at], np.append(first, int(n.sum()))


def batches(file: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of a block with their texts, about SUB bytes at a time."""
    for batch in read_block(file):
        texts, start, total = [x or b"" for x in batch.column("__text").to_pylist()], 0, 0
        for i, t in enumerate(texts):
            if total and total + len(t) > SUB:
                yield batch.slice(start, i - start), texts[start:i]
                start, total = i, 0
            total += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts summed."""
    by = np.argsort(keys)
    keys, counts = keys[by], counts[by]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Tally:
    """Sums counts of keys, kept short by summing now and then."""

    def __init__(self):
        self.parts: list = []
        self.size = self.last = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * self.last + 1_500_000:
            self.parts = [self.result()]
            self.size = self.last = len(self.parts[0][0])

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased words between ASCII white space."""
    return text.translate(_LOWER).split()


def shard_of(keys: np.ndarray, depth: int, shards: int) -> np.ndarray:
    top = keys >> np.uint64(8 * (depth - 1)) if depth > 1 else keys >> np.uint64(8)
    return ((top * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % shards


def block_counts(file: str, depth: int, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, distinct grams and training counts) and, with shards from ``shards`` on, (.., words and training counts)."""
    g, w = Tally(), WordCounter()
    for batch, texts in batches(file):
        train = batch.column("__train").to_numpy(zero_copy_only=False)
        keys, first = grams(texts, depth)
        sent = np.repeat(train, np.diff(first))
        some = np.sort(keys[sent])
        at = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1]))) if len(some) else np.zeros(0, np.int64)
        g.add(some[at], np.diff(np.append(at, len(some))))
        held = np.unique(keys[~sent])
        g.add(held, np.zeros(len(held), np.int64))
        for t, learn in zip(texts, train.tolist()):
            if learn:
                w.update(words_of(t))
            else:
                w.update(dict.fromkeys(words_of(t), 0))
    keys, counts = g.result()
    to = shard_of(keys, depth, shards)
    by = np.argsort(to, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(to[by])) + 1):
        if len(part):
            yield int(to[part[0]]), pack(planes(keys[part]), counts[part])
    dealt: dict = {}
    for word in w:
        dealt.setdefault(zlib.crc32(word) % shards, []).append(word)
    for k, words in dealt.items():
        yield shards + k, pack_words(words, np.array([w[x] for x in words], np.int64))


def pack_words(words: list[bytes], values: np.ndarray) -> bytes:
    return pack(np.frombuffer(b" ".join(words), np.uint8), values)


def unpack_words(data: bytes) -> tuple[list[bytes], np.ndarray]:
    text, values = unpack(data)
    return text.tobytes().split(b" "), values


def merged(rows: list[tuple[int, bytes]]) -> tuple[list, np.ndarray, np.ndarray]:
    """[(block, its keys)], all distinct keys and their counts."""
    tally, own = Tally(), []
    for block, data in rows:
        p, counts = unpack(data)
        keys = unplanes(p)
        own.append((block, keys))
        tally.add(keys, counts)
    return own, *tally.result()


class Tree:
    """The nodes at depths 2 to ``depth`` under the grams of one shard."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.depth, self.least = depth, min(2, depth)
        self.rows = {depth: (keys, counts)}
        self.up: dict = {}
        for d in range(depth - 1, self.least - 1, -1):
            k, c = self.rows[d + 1]
            shorter = (k >> np.uint64(16) << np.uint64(8)) | (k & np.uint64(255))
            new, inverse = np.unique(shorter, return_inverse=True)
            self.rows[d] = (new, np.bincount(inverse, c, len(new)).astype(np.int64))
            self.up[d + 1] = inverse
        self.node: dict = {}
        for d in range(depth, self.least - 1, -1):
            k, c = self.rows[d]
            for bit in range(8):
                group = k >> np.uint64(8 - bit)
                new = np.concatenate(([True], group[1:] != group[:-1]))
                first = np.flatnonzero(new)
                one = (k >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
                self.node[d, bit] = [np.cumsum(new) - 1, first, np.add.reduceat(np.where(one, 0, c), first), np.add.reduceat(np.where(one, c, 0), first), None, None]
        for bit in range(8):
            for d in range(depth, self.least - 1, -1):
                _, first, a, b, *_ = n = self.node[d, bit]
                kt = log_kt(a, b)
                if d == depth:
                    n[4] = kt
                else:
                    _, below, *_, weighted, _ = self.node[d + 1, bit]
                    children = np.bincount(n[0][self.up[d + 1][below]], weighted, len(first))
                    n[4] = np.logaddexp(_HALF + kt, _HALF + children)
                    n[5] = np.exp(_HALF + kt - n[4])

    def tops(self) -> Iterator[tuple[int, int, int, int, float]]:
        """(latest byte, node, zeros, ones, summed log probability) of the shard's share of the nodes at depth 1."""
        k, _ = self.rows[self.least]
        for bit in range(8):
            _, first, a, b, weighted, _ = self.node[self.least, bit]
            latest = (k[first] >> np.uint64(8 * self.least)).astype(np.int64)
            at = latest * 256 + (1 << bit | ((k[first] & np.uint64(255)) >> np.uint64(8 - bit)).astype(np.int64))
            ids, inverse = np.unique(at, return_inverse=True)
            for i, x, y, s in zip(ids.tolist(), np.bincount(inverse, a).tolist(), np.bincount(inverse, b).tolist(), np.bincount(inverse, weighted).tolist()):
                yield i >> 8, i & 255, int(x), int(y), s

    def log10(self, root: Root) -> np.ndarray:
        """log10 of the probability of each gram's byte in its context."""
        keys, _ = self.rows[self.depth]
        row = {self.depth: np.arange(len(keys))}
        for d in range(self.depth, self.least, -1):
            row[d - 1] = self.up[d][row[d]]
        latest, byte = (keys >> np.uint64(8 * self.depth)).astype(np.int64), (keys & np.uint64(255)).astype(np.int64)
        out = np.zeros(len(keys))
        for bit in range(8):
            one = byte >> (7 - bit) & 1 == 1
            p = None
            for d in range(self.depth, self.least - 1, -1):
                index, _, a, b, _, w = self.node[d, bit]
                at = index[row[d]]
                here = (np.where(one, b[at], a[at]) + 0.5) / ((a + b)[at] + 1)
                p = here if p is None else w[at] * here + (1 - w[at]) * p
            out += np.log10(root.finish(latest, 1 << bit | byte >> (8 - bit), one, p))
        return out


class Root:
    """The nodes at depths 1 and 0: arrays of 256 * 256 and 256."""

    def __init__(self, rows: list):
        self.a, self.b, below = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64), np.zeros((256, 256))
        for latest, node, a, b, s in rows:
            self.a[latest, node], self.b[latest, node], below[latest, node] = a, b, s
        kt = log_kt(self.a, self.b)
        weighted = np.logaddexp(_HALF + kt, _HALF + below)
        self.w = np.exp(_HALF + kt - weighted)
        self.a0, self.b0 = self.a.sum(0), self.b.sum(0)
        kt0 = log_kt(self.a0, self.b0)
        self.w0 = np.exp(_HALF + kt0 - np.logaddexp(_HALF + kt0, _HALF + weighted.sum(0)))

    def finish(self, latest, node, one, p):
        a, b, w = self.a[latest, node], self.b[latest, node], self.w[latest, node]
        p = w * (np.where(one, b, a) + 0.5) / (a + b + 1) + (1 - w) * p
        a0, b0, w0 = self.a0[node], self.b0[node], self.w0[node]
        return w0 * (np.where(one, b0, a0) + 0.5) / (a0 + b0 + 1) + (1 - w0) * p


class Lookup:
    """Values of sorted distinct keys by a table of slots; keys that lost their slot to another are searched for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.values = keys[by], values[by]
        self.bits = np.uint64(64 - max(8, (6 * len(keys)).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.bits)), np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        lost = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else []
        if len(lost):
            at[lost] = np.searchsorted(self.keys, keys[lost])
        return self.values[at]


def block_scores(file: str, depth: int, gram_rows: list[bytes], word_rows: list[bytes], totals: tuple[int, int, int]) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """(batch, n_tokens, n_known, base_score, score) of a block's rows. totals: N, V and the training texts."""
    tokens, distinct, docs = totals
    got = [unpack(x) for x in gram_rows] or [(np.zeros(0, np.uint8), np.zeros(0))]
    of_gram = Lookup(np.concatenate([unplanes(p) for p, _ in got]), np.concatenate([v.astype(np.float64) for _, v in got]))
    of_word: dict = {}
    for x in word_rows:
        words, counts = unpack_words(x)
        of_word.update(zip(words, counts.tolist()))
    count, scale = of_word.__getitem__, np.log10(tokens + 0.5 * (distinct + 1))
    for batch, texts in batches(file):
        keys, first = grams(texts, depth)
        score = np.add.reduceat(of_gram(keys), first[:-1])
        size, n, known, base = (np.zeros(len(texts), k) for k in (np.int64, np.int64, np.int64, np.float64))
        for i, t in enumerate(texts):
            c = np.array(list(map(count, words_of(t))), np.int64)
            size[i], n[i], known[i], base[i] = len(t), len(c) + 1, np.count_nonzero(c), np.log10(c + 0.5).sum()
        yield batch, {
            "n_tokens": n, "n_known": known + int(docs > 0), "base_score": base + np.log10(docs + 0.5) - n * scale, "score": score,
            "bits_per_byte": -score * np.log2(10) / (size + 1),
        }


def language_scores(docs: DataFrame, held_out=None, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Rows for which ``held_out`` (a condition) is not true are learned from; all rows are scored. Null texts count as empty,
    an empty text is its end alone. Without training rows every bit has probability one half. Rows with equal ids are
    scored each; very long texts are scored whole; other columns are not read, so their names may clash. An empty table
    gives no rows.
    """
    where = shared_dir(docs.sparkSession)
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"), (~held).alias("__train"))
    id_type = src.schema["__id"].dataType
    blocks = Blocks(src, f"{where}/blocks")
    shards = max(8, len(blocks))
    pairs = "target int, block int, payload binary"

    def count(rows):
        for batch in rows:
            for r in batch.to_pylist():
                for to, data in block_counts(r["file"], depth, shards):
                    yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([r["block"]], pa.int32()), pa.array([data], pa.binary())], names=["target", "block", "payload"])

    sent = stored(blocks.spread().mapInArrow(count, pairs), f"{where}/counts")
    of_grams, of_words = sent.filter(f"target < {shards}"), sent.filter(f"target >= {shards}")

    def top(t: pa.Table) -> pa.Table:
        _, keys, counts = merged(_rows(t))
        rows = list(Tree(keys, counts, depth).tops())
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("latest", "node", "a", "b", "s"), cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()))})

    # at most 256 * 255 rows
    level = of_grams.groupBy("target").applyInArrow(top, "latest int, node int, a bigint, b bigint, s double").groupBy("latest", "node").agg(F.sum("a"), F.sum("b"), F.sum("s")).collect()
    root = Root([tuple(r) for r in level])

    def price(t: pa.Table) -> pa.Table:
        own, keys, counts = merged(_rows(t))
        p = Tree(keys, counts, depth).log10(root).astype(np.float32)
        return _answers([(b, True, pack(planes(k), p[np.searchsorted(keys, k)])) for b, k in own])

    def tell(t: pa.Table) -> pa.Table:
        got = [(b, *unpack_words(d)) for b, d in _rows(t)]
        total = WordCounter()
        for _, words, counts in got:
            for w, c in zip(words, counts.tolist()):
                total[w] += c
        return _answers([(b, False, pack_words(words, np.array([total[w] for w in words], np.int64))) for b, words, _ in got], sum(total.values()), sum(c > 0 for c in total.values()))

    answer = "block int, is_gram boolean, payload binary, tokens bigint, words bigint"
    told = stored(of_words.groupBy("target").applyInArrow(tell, answer), f"{where}/words")
    n, v = told.agg(F.sum("tokens"), F.sum("words")).first()
    trained = src.filter("__train").count()
    totals = ((n or 0) + trained, (v or 0) + int(trained > 0), trained)
    rows = of_grams.groupBy("target").applyInArrow(price, answer).unionByName(told).select("block", "is_gram", "payload", F.lit(None).cast("string").alias("file"))
    rows = rows.unionByName(blocks.files.select("block", F.lit(None).cast("boolean").alias("is_gram"), F.lit(None).cast("binary").alias("payload"), "file"))
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")

    def score(t: pa.Table) -> pa.Table:
        file = next(x for x in t.column("file").to_pylist() if x)
        flags, data = t.column("is_gram").to_pylist(), t.column("payload").to_pylist()
        out = []
        for batch, got in block_scores(file, depth, [d for f, d in zip(flags, data) if f], [d for f, d in zip(flags, data) if f is False], totals):
            got["train_tokens"] = np.full(len(got["score"]), totals[0], np.int64)
            held_out_ = pa.array(~batch.column("__train").to_numpy(zero_copy_only=False))
            out.append(pa.RecordBatch.from_arrays([batch.column("__id"), held_out_, *[pa.array(got[k]) for k in names]], names=[id_col, "held_out", *names]))
        if not out:
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            return pa.table([next(read_block(file)).column("__id"), *[pa.array([], k) for k in kinds]], names=[id_col, "held_out", *names])
        return pa.Table.from_batches(out)

    return rows.groupBy("block").applyInArrow(score, f"`{id_col}` {id_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double")


def _rows(t: pa.Table) -> list[tuple[int, bytes]]:
    return list(zip(t.column("block").to_pylist(), t.column("payload").to_pylist()))


def _answers(rows: list, tokens: int = 0, words: int = 0) -> pa.Table:
    """The totals stand in the first row only."""
    k = len(rows)
    return pa.table({
        "block": pa.array([r[0] for r in rows], pa.int32()), "is_gram": pa.array([r[1] for r in rows], pa.bool_()), "payload": pa.array([r[2] for r in rows], pa.binary()),
        "tokens": pa.array(([tokens] + [0] * k)[:k], pa.int64()), "words": pa.array(([words] + [0] * k)[:k], pa.int64()),
    })


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"), held_fold("doc_id", 5, 1))
