"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are linked where at most 4 bits differ. Cut into six blocks, such a pair agrees on two of them at
least, so a join on each of the fifteen pairs of blocks meets every link. Buckets hold distinct fingerprints only; within
one, links are verified by Hamming distance and only a spanning forest leaves it. A bucket that is too large for one task
is dealt anew: what is left of the bits is cut into six blocks again, which loses no link and ends when few bits are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_texts, shared_dir, stored, table, trim
from .components import components

BITS, BLOCKS, WORDS, DISTANCE, SEED = 64, 6, 4, 4, 42
#: The pipeline's stage: words of a shingle and least Jaccard similarity; bands of MinHashes and their number in a band.
STAGE_WORDS, SIMILAR, BANDS, BAND = 5, 0.8, 24, 5
#: Bits of each MinHash that a pair's sketches are compared by, and the most of them that may differ: at a similarity of 0.8
#: the difference is 24 on average with a deviation of 5.6, so a pair is passed over with a probability of 0.000003.
SKETCH, APART = 2, 49
#: Distinct fingerprints that one task compares at most; larger buckets are dealt anew.
BUCKET = 8192
SKETCHES = -(-BANDS * BAND * SKETCH // 64)
#: Classes of a bucket that are all compared in pairs at most; of larger buckets those that share a rare shingle are.
PAIRS = 32
#: Shingles hashed at once, so that memory does not follow a text's length.
PART = 200_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GAPS = bytes([9, 10, 11, 12, 13])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of a text: a bit is set where over half of the shingles' hashes have it; 0 without words."""
    tokens = text.translate(_LOWER).split()  # ASCII white space: \\x20 and \\x09 to \\x0D
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, PART):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[lo : min(n, lo + PART)].tolist(), last[lo : lo + PART].tolist())], np.uint64)
        ones += count_bits(h)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def count_bits(h: np.ndarray) -> np.ndarray:
    """For each of the 64 bits, how many of the hashes have it."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fingerprints as signed longs. Null and empty texts have fingerprint 0; other columns are not read."""
    return map_texts(docs, Fingerprints(words), "fp bigint", id_col, text_col)


class Fingerprints:
    def __init__(self, words: int):
        self.words = words

    def __call__(self, texts: list) -> dict:
        return {"fp": np.array([fingerprint(t, self.words) for t in texts], np.uint64).view(np.int64)}


def masks(agreed: int = 0) -> list[int]:
    """Masks that add two of six blocks of the bits outside ``agreed`` to it."""
    rest = [i for i in range(BITS) if not agreed >> i & 1]
    cut = [rest[len(rest) * k // BLOCKS : len(rest) * (k + 1) // BLOCKS] for k in range(BLOCKS)]
    return [agreed | sum(1 << i for k in pair for i in cut[k]) for pair in combinations(range(BLOCKS), BLOCKS - DISTANCE)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[int, np.ndarray]]:
    """The components among distinct fingerprints: (its first, the others), by searching from one after another."""
    left = fps
    while len(left) > 1:
        root, left = left[0], left[1:]
        found, queue = [], [root]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= distance
            if near.any():
                got = left[near]
                found.append(got)
                queue.extend(got)
                left = left[~near]
        if found:
            yield root, np.concatenate(found)


def join_buckets(batches: Iterator[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, value, fp), sorted: edges (a, b, mask null) of each bucket's forest, or, from buckets of over ``bucket``
    fingerprints, the rows themselves with their mask for the next round."""
    rest = None  # the last bucket of what came so far, which may go on
    passing = None  # the bucket whose rows are passed on

    def emit(parts: list) -> pa.RecordBatch:
        a, b, m = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(m)], names=["a", "b", "mask"])

    def solve(rows: np.ndarray, out: list) -> None:
        change = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
        edges = np.concatenate(([0], change, [len(rows)]))
        for k in np.flatnonzero(np.diff(edges) > 1).tolist():
            group = np.unique(rows[edges[k] : edges[k + 1], 2]).view(np.uint64)
            if len(group) == 2:
                if int(group[0] ^ group[1]).bit_count() <= DISTANCE:
                    out.append((group[:1].view(np.int64), group[1:].view(np.int64), np.zeros(1, np.int64)))
                continue
            for root, others in forest(group):
                out.append((np.full(len(others), root, np.uint64).view(np.int64), others.view(np.int64), np.zeros(len(others), np.int64)))

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
        out: list = []
        if passing is not None:
            same = (rows[:, 0] == passing[0]) & (rows[:, 1] == passing[1])
            n = len(rows) if same.all() else int(np.argmin(same))
            out.append((rows[:n, 2], rows[:n, 2], rows[:n, 0]))
            rows = rows[n:]
            if len(rows):
                passing = None
        if len(rows):
            rows = rows if rest is None else np.concatenate((rest, rows))
            tail = int(np.argmax((rows[:, 0] == rows[-1, 0]) & (rows[:, 1] == rows[-1, 1])))
            body, rest = rows[:tail], rows[tail:]
            start = 0
            if len(body):
                change = np.flatnonzero((body[1:, 0] != body[:-1, 0]) | (body[1:, 1] != body[:-1, 1])) + 1
                edges = np.concatenate(([0], change, [len(body)]))
                for k in np.flatnonzero(np.diff(edges) > bucket).tolist():
                    solve(body[start : edges[k]], out) if edges[k] > start else None
                    big = body[edges[k] : edges[k + 1]]
                    out.append((big[:, 2], big[:, 2], big[:, 0]))
                    start = edges[k + 1]
                if start < len(body):
                    solve(body[start:], out)
            if len(rest) > bucket:
                out.append((rest[:, 2], rest[:, 2], rest[:, 0]))
                passing, rest = rest[0, :2].copy(), None
        if out:
            yield emit(out)
    if rest is not None and len(rest) > 1:
        out = []
        solve(rest, out)
        if out:
            yield emit(out)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): a spanning forest of the link graph on the distinct fingerprints in column fp."""
    spark, where = fps.sparkSession, shared_dir(fps.sparkSession)
    todo = fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    done, k = None, 0
    while todo is not None:
        before = [0] if k == 0 else [r["mask"] for r in todo.select("mask").distinct().collect()]  # 15 for each earlier round's
        keys = [F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for b in before for m in masks(b & (1 << 64) - 1)]
        if k == 0:
            rows = todo.select(F.explode(F.array(*keys)).alias("k"), "fp")
        else:
            made = spark.createDataFrame([(b, signed(m)) for b in before for m in masks(b & (1 << 64) - 1)], "mask long, next long")
            rows = todo.join(F.broadcast(made), "mask").select(F.struct(F.col("next").alias("mask"), F.col("fp").bitwiseAND(F.col("next")).alias("value")).alias("k"), "fp")
        rows = rows.select("k.mask", "k.value", "fp")
        dealt = rows.repartition("mask", "value").sortWithinPartitions("mask", "value")
        out = stored(dealt.mapInArrow(lambda batches: join_buckets(batches, bucket), "a bigint, b bigint, mask bigint"), f"{where}/round-{k}")
        found = out.filter("a <> b").select("a", "b")
        done = found if done is None else done.unionByName(found)
        large = out.filter("a = b").select("mask", F.col("a").alias("fp"))
        todo = None if large.isEmpty() else large
        k += 1
    return done


def near_duplicates(docs: DataFrame, words: int = WORDS, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (the least id reachable by links).

    Documents with one fingerprint are one class, whose least id stands for it; links are sought between classes.
    Documents without words share fingerprint zero. Rows with a null id have a null component and link nothing, rows with
    equal ids are one node for each fingerprint. An empty table gives no rows.
    """
    where = shared_dir(docs.sparkSession)
    prints = stored(fingerprints(docs, words, id_col, text_col), f"{where}/prints")
    classes = stored(prints.filter(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("rep"), F.max(id_col).alias("top"), F.count("*").alias("n")), f"{where}/classes")
    pairs = links(classes.select("fp"), bucket)
    ends = pairs.join(classes.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(classes.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b")
    found = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = stored(classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("label", "rep").alias("component_id")), f"{where}/named")
    return prints.join(named, "fp", "left").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id")
    )


def shingles(text: bytes, words: int = STAGE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a text of fewer words is one shingle, none without words."""
    tokens = text.translate(_LOWER).split()
    h = [xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), SEED) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    return np.unique(np.array(h, np.uint64))


class Sets:
    """For each text a hash of its set of shingles, its fingerprint, and of its MinHash signature a hash of each band and
    the lowest bits of all."""

    def __init__(self, words: int):
        rng = np.random.default_rng(SEED)
        self.words = words
        self.odd, self.plus = (rng.integers(0, 1 << 63, BANDS * BAND, np.uint64) for _ in range(2))
        self.odd = self.odd << np.uint64(1) | np.uint64(1)

    def __call__(self, texts: list) -> dict:
        keys, prints, bands, bits = [], [], [], []
        for t in texts:
            h = shingles(t, self.words)
            keys.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
            prints.append(sum(1 << i for i in np.flatnonzero(2 * count_bits(h) > len(h)).tolist()))
            low = np.full(BANDS * BAND, ~np.uint64(0))
            for lo in range(0, len(h), 2048):
                x = h[lo : lo + 2048, None] * self.odd + self.plus
                x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
                low = np.minimum(low, x.min(0))
            bands.append([xxhash.xxh64_intdigest(low[k : k + BAND].tobytes(), k) for k in range(0, len(low), BAND)])
            bits.append(np.packbits((low[:, None] >> np.arange(SKETCH, dtype=np.uint64) & np.uint64(1)).astype(bool).ravel()))
        return {"key": np.array(keys, np.uint64).view(np.int64), "fp": np.array(prints, np.uint64).view(np.int64), "bands": _lists(np.array(bands, np.uint64), BANDS), "sketch": _lists(np.pad(np.array(bits, np.uint8).reshape(len(texts), -1), ((0, 0), (0, -len(bits[0]) % 8))).view(np.uint64) if texts else np.zeros(0, np.uint64), SKETCHES)}


def _lists(values: np.ndarray, width: int) -> pa.ListArray:
    flat = np.ascontiguousarray(values).reshape(-1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) // width + 1) * width, pa.int32()), pa.array(flat))


class Shingles:
    """For each text its set of shingles and the hash of the set."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, texts: list) -> dict:
        sets = [shingles(t, self.words).tobytes() for t in texts]
        return {"key": np.array([xxhash.xxh64_intdigest(x, SEED) for x in sets], np.uint64).view(np.int64), "shingles": pa.array(sets, pa.binary())}


def similar(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) of keys whose sets have a Jaccard similarity of ``share`` at least."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= share * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        trim()

    rows = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def apart(x: str, y: str) -> Column:
    """In how many bits two sketches differ."""
    return F.expr(" + ".join(f"bit_count({x}[{k}] ^ {y}[{k}])" for k in range(SKETCHES)))


def in_blocks(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows with a number of a block, whose sets have about ``most`` bytes; a larger set is a block of its own."""
    block, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        of = []
        for n in pc.binary_length(batch.column("shingles")).to_pylist():
            if held and held + n > most:
                block, held = block + 1, 0
            of.append(block)
            held += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int64())], names=[*batch.schema.names, "block"])


def block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, token, n): in how many sets of a block each shingle is; a block may come in several parts."""
    for batch in batches:
        block = batch.column("block").to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)])) if len(block) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            token, n = np.unique(np.frombuffer(b"".join(batch.column("shingles").slice(lo, hi - lo).to_pylist()), np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), block[lo])), pa.array(token.view(np.int64)), pa.array(n)], names=["block", "token", "n"])


def prefixes(sets: pa.Table, counts: pa.Table, share: float) -> pa.Table:
    """(token, n, left, often, key, sketch) for the shingles by which a set of n can first meet one that is similar.

    Shingles are ordered by the number of sets that they are in (``counts`` has those of two sets at least), rare ones first.
    What two sets have in common stands at or behind the first shingle that they share, so ``left``, the number of a set's
    shared shingles from there on, is no less than that, and that is no less than ``share`` of n. ``often`` of a set's
    shingles are in over PAIRS sets.
    """
    token, at = np.unique(counts.column("token").to_numpy().view(np.uint64), return_index=True)
    rank = np.empty(len(token), np.int64)
    df = counts.column("df").to_numpy()[at]
    rank[np.lexsort((token, df))] = np.arange(len(token))
    rows, parts = [], []
    for i, x in enumerate(sets.column("shingles").to_pylist() if len(token) else []):
        x = np.frombuffer(x, np.uint64)
        k = np.minimum(np.searchsorted(token, x), len(token) - 1)
        k = k[token[k] == x]
        k = k[np.argsort(rank[k])]
        left, often = len(k) - np.arange(len(k)), np.count_nonzero(df[k] > PAIRS)
        k = k[left >= share * len(x) - 1e-6]
        rows.append(np.full(len(k), i))
        parts.append((token[k], np.full(len(k), len(x)), left[: len(k)], np.full(len(k), often)))
    if not rows:
        rows, parts = [np.zeros(0, np.int64)], [(np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3]
    first, *numbers = (np.concatenate(x) for x in zip(*parts))
    more = sets.select(["key", "sketch"]).take(pa.array(np.concatenate(rows)))
    return pa.table({"token": first.view(np.int64), **dict(zip(("n", "left", "often"), (x.astype(np.int64) for x in numbers))), **{c: more.column(c) for c in more.column_names}})


class Tokens:
    """The rows of ``prefixes`` with a label, sorted by token, in parts of whole tokens."""

    def __init__(self, rows: tuple, share: float):
        self.token, self.n, self.left, self.often, self.key, self.label, self.sketch = rows
        self.least = share / (1 + share)
        self.cuts = np.concatenate(([0], np.flatnonzero(self.token[1:] != self.token[:-1]) + 1, [len(self.token)]))

    @classmethod
    def read(cls, batches: Iterator[pa.RecordBatch], share: float) -> Iterator[Tokens]:
        rest = []  # the rows of the last token of what came so far, which may go on
        for batch in batches:
            if not len(batch):
                continue
            rows = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "n", "left", "often", "key", "label"))
            rows += (batch.column("sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(batch), SKETCHES),)
            if rest and rows[0][-1] == rest[0][0][0]:
                rest.append(rows)
                continue
            rows = tuple(map(np.concatenate, zip(*rest, rows)))
            tail = int(np.argmax(rows[0] == rows[0][-1]))
            if tail:
                yield cls(tuple(x[:tail] for x in rows), share)
            rest = [tuple(x[tail:] for x in rows)]
        if rest:
            yield cls(tuple(map(np.concatenate, zip(*rest))), share)

    def near(self, n: np.ndarray, left: np.ndarray, m: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.minimum(left, right) >= self.least * (n + m) - 1e-6

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Those of the rows i and j that can be similar by their numbers and sketches and have different labels: (a, b)."""
        good = (self.label[i] != self.label[j]) & self.near(self.n[i], self.left[i], self.n[j], self.left[j])
        i, j = i[good], j[good]
        good = np.bitwise_count(self.sketch[i] ^ self.sketch[j]).sum(1, dtype=np.int64) <= APART
        a, b = self.key[i[good]], self.key[j[good]]
        return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)

    def centres(self) -> Iterator[np.ndarray]:
        """Of each token that has many rows, those with the one that has the largest share of frequent shingles."""
        for lo, hi in zip(self.cuts[:-1], self.cuts[1:]):
            if hi - lo > PAIRS:
                first = lo + np.lexsort((self.key[lo:hi], -self.often[lo:hi] / self.n[lo:hi]))[0]
                yield self.pairs(np.full(hi - lo, first), np.arange(lo, hi))

    def all(self) -> Iterator[np.ndarray]:
        """All pairs of rows of one token. Where it has many rows, they are first told apart by their numbers, which are few,
        so those that can meet none take no part in any pair."""
        size = np.diff(self.cuts)
        small = np.repeat(size <= PAIRS, size)
        for d in range(1, min(PAIRS, int(size.max()))):
            i = np.flatnonzero((self.token[d:] == self.token[:-d]) & small[d:])
            yield self.pairs(i, i + d)
        for t in np.flatnonzero(size > PAIRS).tolist():
            lo, hi = self.cuts[t], self.cuts[t + 1]
            kinds, of = np.unique(np.stack([self.n[lo:hi], self.left[lo:hi]], 1), axis=0, return_inverse=True)
            of = of.reshape(-1)
            member = np.split(lo + np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])
            low, high = np.full(len(kinds), np.iinfo(np.int64).max), np.full(len(kinds), np.iinfo(np.int64).min)
            np.minimum.at(low, of, self.label[lo:hi])
            np.maximum.at(high, of, self.label[lo:hi])
            for k in range(len(kinds)):
                hit = self.near(*kinds[k], *kinds[k:].T) & ((low[k] != high[k]) | (low[k:] != high[k:]) | (low[k] != low[k:]))
                if hit.any():
                    others = np.concatenate([member[k + j] for j in np.flatnonzero(hit).tolist()])
                    step = max(1, 1_000_000 // len(others))
                    for at in range(0, len(member[k]), step):
                        some = member[k][at : at + step]
                        yield self.pairs(np.repeat(some, len(others)), np.tile(others, len(some)))


def meet(batches: Iterator[pa.RecordBatch], share: float, centres: bool = False) -> Iterator[pa.RecordBatch]:
    for part in Tokens.read(batches, share):
        for x in part.centres() if centres else part.all():
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])
    trim()


def rare_shingles(sets: DataFrame, share: float, where: str) -> DataFrame:
    """(token, n, left, often, key, sketch) of ``prefixes`` for all sets. ``sets``: key, sketch, shingles."""
    blocks = stored(sets.mapInArrow(in_blocks, "key bigint, sketch array<bigint>, shingles binary, block bigint"), f"{where}/blocks", 8 << 20)
    counts = stored(blocks.select("block", "shingles").mapInArrow(block_counts, "block bigint, token bigint, n bigint"), f"{where}/counts")
    shared = counts.groupBy("token").agg(F.sum("n").alias("df")).filter("df > 1")
    known = counts.select("block", "token").join(shared, "token").select("block", "token", "df")
    rows = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda x, y: prefixes(x, y, share), "token bigint, n bigint, left bigint, often bigint, key bigint, sketch array<bigint>")
    return stored(rows, f"{where}/prefixes")


def rare_pairs(rows: DataFrame, labels: DataFrame, share: float, centres: bool = False) -> DataFrame:
    """(a, b): pairs of keys among which are all that have different labels, near sketches and sets with a Jaccard similarity
    of ``share`` at least. ``rows``: of rare_shingles; ``labels``: key, label of each.

    Two such sets share one of their rarest shingles. What many have in common is rare in none of them, so copies that were
    all changed in other places make few pairs, where their bucket has as many as the square of its size. ``centres``: of a
    shingle that many have, only the pairs with that which has least of its own.
    """
    dealt = rows.join(labels, "key").select("token", "n", "left", "often", "key", "label", "sketch").repartition("token").sortWithinPartitions("token")
    return dealt.mapInArrow(lambda batches: meet(batches, share, centres), "a bigint, b bigint").distinct()


def similar_documents(docs: DataFrame, words: int = STAGE_WORDS, share: float = SIMILAR, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text", pairs: int = PAIRS) -> DataFrame:
    """(id, component_id) for each row with an id: the least id that is reachable by pairs with a Jaccard similarity of
    their sets of shingles of ``share`` at least.

    Equal sets are one class. Classes whose SimHash fingerprints are near, found by pigeonhole blocks as in ``links``, are
    compared first. Fingerprints of pairs at 0.8 differ in more bits than blocks can bear, so classes that agree in a band of
    MinHashes are compared as well, unless they are linked already; a pair at 0.8 has such a band with a probability of
    0.9999. In a bucket all are compared with its first, then those that are still in different components with each other,
    if their sketches are near enough and, in a bucket of over ``pairs`` classes, if they share a rare shingle, as similar
    ones do; of those, each is compared with the most central one of its frequent shingles before.
    Sets are only made of texts that a pair asks for.
    """
    where = shared_dir(docs.sparkSession)
    known = docs.filter(F.col(id_col).isNotNull())
    made = stored(map_texts(known, Sets(words), "key bigint, fp bigint, bands array<bigint>, sketch array<bigint>", id_col, text_col), f"{where}/sets")
    least = stored(made.groupBy("key").agg(F.min(id_col).alias("rep"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch")), f"{where}/classes")
    rows = made.join(least.select("key", F.col("rep").alias(id_col)), ["key", id_col], "left_semi").select("key", "sketch", F.posexplode("bands").alias("band", "value"))

    def sets_of(keys: DataFrame, name: str) -> DataFrame:
        asked = stored(keys.distinct().join(least.select("key", "rep"), "key"), f"{where}/{name}-asked")
        texts = known.join(asked.select(F.col("rep").alias(id_col)).distinct(), id_col, "left_semi")
        sets = map_texts(texts, Shingles(words), "key bigint, shingles binary", id_col, text_col).join(asked.select("key", F.col("rep").alias(id_col)), ["key", id_col], "left_semi")
        return stored(sets.dropDuplicates(["key"]).select("key", "shingles"), f"{where}/{name}-sets", 8 << 20)

    def verified(found: DataFrame, name: str) -> DataFrame:
        found = stored(found, f"{where}/{name}-pairs")
        return stored(similar(found, sets_of(found.select(F.explode(F.array("a", "b")).alias("key")), name), share), f"{where}/{name}")

    # classes of one fingerprint are linked to the first of them, which stands for the fingerprint
    first = least.groupBy("fp").agg(F.min("key").alias("head"))
    ends = links(least.select("fp").distinct(), bucket)
    near = ends.join(first.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    near = near.distinct().unionByName(least.join(first, "fp").filter("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b")))
    edges = verified(near, "near")
    shared = rows.groupBy("band", "value").agg(F.min(F.struct("key", "sketch")).alias("h"), F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(shared.select("band", "value", F.col("h.key").alias("a"), F.col("h.sketch").alias("of_a")), ["band", "value"])
    # pairs whose sketches are far apart are not even made
    rows = stored(rows.withColumn("close", apart("sketch", "of_a") <= APART).drop("of_a"), f"{where}/buckets")

    def labelled(edges: DataFrame, name: str) -> DataFrame:
        labels = components(edges).select(F.col("node").alias("key"), "label")
        return stored(rows.join(labels, "key", "left").select("band", "value", "a", "key", "sketch", "close", F.coalesce("label", "key").alias("label")), f"{where}/{name}")

    # each class is compared with one first of its buckets, then with those that it is not linked to by that
    one = rows.filter("close AND key <> a").groupBy("key").agg(F.min("a").alias("a")).select("a", F.col("key").alias("b"))
    edges = edges.unionByName(verified(one, "one"))
    now = labelled(edges, "labelled-0")
    heads = now.filter("key = a").select("band", "value", F.col("label").alias("__of"))
    stars = now.filter("close AND key <> a").join(heads, ["band", "value"]).filter("label <> __of").select("a", F.col("key").alias("b")).distinct()
    edges = edges.unionByName(verified(stars, "stars"))
    now = labelled(edges, "labelled-1")
    mixed = now.groupBy("band", "value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("band", "value", "n")
    now = stored(now.join(mixed, ["band", "value"]).filter("key <> a"), f"{where}/mixed")
    near = (F.col("x.band") == F.col("y.band")) & (F.col("x.value") == F.col("y.value")) & F.expr("x.key < y.key AND x.label <> y.label") & (apart("x.sketch", "y.sketch") <= APART)
    few, many = now.filter(F.col("n") <= pairs), now.filter(F.col("n") > pairs)
    more = few.alias("x").join(few.alias("y"), near).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    if not many.isEmpty():
        # those near the middle of a group are linked by it, so only those far from it are left for pairs
        many = stored(many.groupBy("key").agg(F.min("label").alias("label"), F.min("sketch").alias("sketch")), f"{where}/many")
        sets = many.join(sets_of(many.select("key"), "many"), "key").select("key", "sketch", "shingles")
        rare = rare_shingles(sets, share, f"{where}/rare")
        edges = edges.unionByName(verified(rare_pairs(rare, many.select("key", "label"), share, centres=True), "centres"))
        labels = components(edges).select(F.col("node").alias("key"), "label")
        labels = stored(many.select("key").join(labels, "key", "left").select("key", F.coalesce("label", "key").alias("label")), f"{where}/labelled-2")
        more = more.unionByName(rare_pairs(rare, labels, share))
    more = more.distinct()
    edges = edges.unionByName(verified(more, "others"))
    found = components(edges).withColumnRenamed("node", "key")
    group = stored(least.join(found, "key", "left").select("key", "rep", F.coalesce("label", "key").alias("label")), f"{where}/groups")
    head = group.groupBy("label").agg(F.min("rep").alias("component_id"))
    return made.select(id_col, "key").join(group.select("key", "label"), "key").join(head, "label").select(id_col, "component_id")


def distinct_documents(docs: DataFrame, words: int = STAGE_WORDS, share: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose component (of similar_documents) has a smaller id; all its columns, unchanged. Null
    ids stay."""
    gone = similar_documents(docs, words, share, id_col=id_col, text_col=text_col).filter(F.col(id_col) > F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
