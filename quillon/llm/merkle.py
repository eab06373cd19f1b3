"""Merkle manifest of a dataset: each row's leaf, its authentication path, and one root for all.

Leaves of a source, in the order of their ids, form a tree of runs of 16; the sources' roots form a tree above. Paths come
from fractal traversal: an aligned block of leaves is walked from left to right with one existing subtree for each level,
whose children are the siblings of the present path, and one desired subtree, the next that the level will need, which
takes in a leaf for each step and so is ready when the walk gets there. A block's walk keeps two subtrees of 16 for each
level beside the block's leaves. The path from the block's root up is the same for all its leaves; it comes from joins over
the nodes above the blocks, level by level, and is appended to each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import shared_dir, stored, table
from .ranks import ranked

#: Children of a node; levels of a block, which has FANOUT ** LEVELS leaves.
FANOUT, LEVELS = 16, 3
PROOF = "array<struct<pos: int, kids: array<string>>>"


def digest(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels between ``n`` nodes and the one that stands for them."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


class Desired:
    """The next subtree of a level: takes its leaves one by one and keeps, for each level below, the run it has begun."""

    def __init__(self, levels: int):
        self.runs: list[list[str]] = [[] for _ in range(levels + 1)]

    def take(self, leaf: str) -> None:
        level, node = 0, leaf
        while level < len(self.runs):
            self.runs[level].append(node)
            if level + 1 == len(self.runs) or len(self.runs[level]) < FANOUT:
                return
            node, self.runs[level], level = digest("".join(self.runs[level])), [], level + 1

    def done(self) -> list[str]:
        """The children of the subtree's root, those of unfinished runs included."""
        for level in range(len(self.runs) - 1):
            if self.runs[level]:
                self.runs[level + 1].append(digest("".join(self.runs[level])))
                self.runs[level] = []
        return self.runs[-1]


class Traversal:
    """Successive authentication paths of a block of leaves within ``levels`` levels.

    A path is a list of (place, children of the parent) from the leaf up. The subtree of level k covers FANOUT ** (k + 1)
    leaves; while the walk is in one, each step puts a leaf of the next into the desired one.
    """

    def __init__(self, leaves: list[str], levels: int):
        self.leaves, self.levels = leaves, levels
        self.wide = [FANOUT ** (k + 1) for k in range(levels)]
        self.existing = [self.built(k, 0) for k in range(levels)]
        self.desired = [Desired(k) for k in range(levels)]

    def built(self, level: int, start: int) -> list[str]:
        """The subtree of the first leaf: what the walk begins with."""
        tree = Desired(level)
        for leaf in self.leaves[start : start + self.wide[level]]:
            tree.take(leaf)
        return tree.done()

    def __iter__(self) -> Iterator[list[tuple[int, list[str]]]]:
        for i in range(len(self.leaves)):
            path = []
            for k, wide in enumerate(self.wide):
                if i and i % wide == 0:  # the walk enters the next subtree of this level
                    self.existing[k], self.desired[k] = self.desired[k].done(), Desired(k)
                path.append((i // (wide // FANOUT) % FANOUT, self.existing[k]))
            yield path
            for k, wide in enumerate(self.wide):
                if i + wide < len(self.leaves):
                    self.desired[k].take(self.leaves[i + wide])


def fold(leaf: str, path) -> str:
    """The root that a leaf and its path give."""
    for pos, kids in path:
        leaf = digest("".join([*kids[:pos], leaf, *kids[pos + 1 :]]))
    return leaf


def siblings(path) -> str:
    return "".join("".join(kids[:pos]) + "".join(kids[pos + 1 :]) for pos, kids in path)


def field(c: Column) -> Column:
    """A value of a leaf: ``-`` for null, else the number of its bytes, a colon, and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def children(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m, kids): the digests of each run, in order. ``nodes``: keys, idx, m and digest; a run has FANOUT at most."""
    kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
    return nodes.groupBy(*keys, "m", F.floor(F.col("idx") / FANOUT).alias("up")).agg(kids.alias("kids"))


def parents(runs: DataFrame, keys: list[str]) -> DataFrame:
    whole = F.sha2(F.array_join("kids", "").cast("binary"), 256)
    return runs.select(*keys, F.col("up").alias("idx"), F.ceil(F.col("m") / FANOUT).alias("m"), whole.alias("digest"))


def forest(nodes: DataFrame, most: int, where: str) -> tuple[DataFrame, DataFrame]:
    """Trees above ``nodes`` (g, idx, m, digest; m nodes in the tree g, ``most`` at most): (g, idx, proof) and (g, top).

    Each level is a FANOUT-th of the one below and is written once. On the way down a node has its parent's path after its
    own siblings: one row meets one row, whatever the size of the tree. Trees of one node have no row in the first table.
    """
    levels, tops, m = [], [nodes.filter("m = 1").select("g", F.col("digest").alias("top"))], most
    while m > 1:
        runs = stored(children(nodes.filter("m > 1"), ["g"]), f"{where}/level-{len(levels)}")
        levels.append(runs)
        nodes, m = parents(runs, ["g"]), -(-m // FANOUT)
        tops.append(nodes.filter("m = 1").select("g", F.col("digest").alias("top")))
    down, none = None, F.array().cast(PROOF)
    for runs in reversed(levels):
        above = runs.withColumn("proof", none) if down is None else runs.join(down.withColumnRenamed("idx", "up"), ["g", "up"], "left").withColumn("proof", F.coalesce("proof", none))
        each = above.select("g", "up", "kids", "proof", F.posexplode("kids").alias("pos", "kid"))
        down = each.select("g", (F.col("up") * FANOUT + F.col("pos")).alias("idx"), F.concat(F.array(F.struct(F.col("pos").cast("int"), "kids")).cast(PROOF), "proof").alias("proof"))
    if down is None:
        down = nodes.filter("false").select("g", "idx", none.alias("proof"))
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return down, top


def manifest(docs: DataFrame, columns: tuple = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tampered: Column | None = None, paths: bool = False, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: the id, leaf, subroot, root, proof_sha256, folded_root and verified; with ``paths`` also
    path, the place and the run of each level from the leaf to the root (``fold`` checks it).

    Leaves are made of ``columns``. ``tampered``: another text; folded_root comes from the leaf that it gives. Null texts, and
    nulls in any other column, are ``-``; null sources are a source of their own, before all others; null ids come first in
    their source. Rows with equal ids are leaves of their own, ordered by their digests, equal rows beside each other. Long
    texts are hashed whole. A single row is its own root, with an empty proof; an empty table gives no rows. Other columns
    are not read.
    """
    spark, where = docs.sparkSession, shared_dir(docs.sparkSession)
    known = [F.col(f"`{c}`") for c in columns]
    leaf = leaf_of(known)
    other = F.lit(None).cast("string") if tampered is None else leaf_of([tampered if c == text_col else F.col(f"`{c}`") for c in columns])
    leaves = stored(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), leaf.alias("leaf"), other.alias("other")).withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other"))), f"{where}/leaves")
    wide = FANOUT**levels
    rows = ranked(leaves, "source", ["id", "leaf"], f"{where}/order").withColumn("block", F.floor(F.col("rank") / wide))
    bounds = rows.agg(F.max("total").alias("n"), (F.max("g") + 1).alias("g")).first()
    most, sources = bounds["n"] or 0, bounds["g"] or 0

    # the blocks' roots: one shuffle by block serves all their levels
    nodes = rows.repartition("g", "block").select("g", "block", F.col("total").alias("m"), F.col("rank").alias("idx"), F.col("leaf").alias("digest"))
    done = []
    for _ in range(min(levels, height(most))):
        done.append(nodes.filter("m = 1"))
        nodes = parents(children(nodes.filter("m > 1"), ["g", "block"]), ["g", "block"])
    for d in done:
        nodes = nodes.unionByName(d)
    nodes = stored(nodes, f"{where}/blocks")
    lower, tops = forest(nodes.select("g", "idx", "m", "digest"), -(-most // wide), f"{where}/blocks-up")
    subroots = stored(tops, f"{where}/subroots")
    upper, top = forest(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(sources).cast("long").alias("m"), F.col("top").alias("digest")), sources, f"{where}/sources-up")
    heads = (
        nodes.select("g", "block").join(lower.select("g", F.col("idx").alias("block"), F.col("proof").alias("low")), ["g", "block"], "left")
        .join(upper.select(F.col("idx").alias("g"), F.col("proof").alias("high")), "g", "left").join(subroots, "g").crossJoin(F.broadcast(top.select(F.col("top").alias("root"))))  # one row
    )
    none = F.array().cast(PROOF)
    heads = heads.select("g", "block", F.lit(-1).cast("long").alias("rank"), F.concat(F.coalesce("low", none), F.coalesce("high", none)).alias("up"), F.col("top").alias("subroot"), "root")
    marked = rows.select("g", "block", "rank", "total", "id", "leaf", "other").unionByName(heads, allowMissingColumns=True)
    dealt = marked.repartition("g", "block").sortWithinPartitions("g", "block", "rank")
    kind = leaves.schema["id"].dataType.simpleString()
    out = f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (f", path {PROOF}" if paths else "")
    return dealt.mapInArrow(Blocks(levels, paths, out_names(id_col, paths)), out)


def out_names(id_col: str, paths: bool) -> list[str]:
    return [id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["path"] if paths else [])]


class Blocks:
    """Walks each block of a partition; its head row comes first and brings the path above the block."""

    def __init__(self, levels: int, paths: bool, names: list[str]):
        self.levels, self.paths, self.names = levels, paths, names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["rank"] < 0:
                    if rows:
                        yield self.walk(head, rows)
                    head, rows = row, []
                else:
                    rows.append(row)
        if rows:
            yield self.walk(head, rows)

    def walk(self, head: dict, rows: list[dict]) -> pa.RecordBatch:
        up = [(x["pos"], x["kids"]) for x in head["up"]]
        above, root = siblings(up).encode(), head["root"]
        columns: list[list] = [[] for _ in self.names]
        for row, low in zip(rows, Traversal([r["leaf"] for r in rows], min(self.levels, height(rows[0]["total"])))):
            folded = fold(row["other"] or row["leaf"], low + up)
            values = [row["id"], row["leaf"], head["subroot"], root, digest(siblings(low).encode() + above), folded, folded == root]
            if self.paths:
                values.append([{"pos": p, "kids": list(k)} for p, k in low + up])
            for column, value in zip(columns, values):
                column.append(value)
        arrays = [pa.array(c) for c in columns[:7]]
        if self.paths:
            arrays.append(pa.array(columns[7], pa.list_(pa.struct([("pos", pa.int32()), ("kids", pa.list_(pa.string()))]))))
        return pa.RecordBatch.from_arrays(arrays, names=self.names)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", upper, lower)).otherwise(F.col("text"))
    return manifest(docs, tampered=tampered)


def _enc(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"


def _leaf(text: str) -> str:
    return f"sha256(concat({', '.join(_enc(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))}))"


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: list_prepend(ord(substr(doc_id::VARCHAR, i, 1))::BIGINT, list_transform(range(8), lambda j: -1::BIGINT))))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_UP = "SELECT t, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (m + 15) // 16 FROM {0} WHERE m > 1 GROUP BY t, level, idx // 16, m"

#: Trees level by level, those of the sources and the one above them; then one step of each path after the other. A step of -1 in
#: the crc32 is a shift by one bit.
SQL = f"""
WITH RECURSIVE s AS (SELECT src, row_number() OVER (ORDER BY src NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT source AS src FROM documents)),
 d AS (SELECT doc_id, t, {_leaf('text')} AS leaf, {_leaf(f'CASE WHEN {_CRC} % 5 = 0 THEN {_LOWER} ELSE text END')} AS other, row_number() OVER (PARTITION BY t ORDER BY doc_id) - 1 AS idx
  FROM documents JOIN s ON source IS NOT DISTINCT FROM src),
 a(t, level, idx, digest, m) AS (SELECT t, 0, idx, leaf, count(*) OVER (PARTITION BY t) FROM d UNION ALL {_UP.format('a')}),
 sub AS (SELECT t, digest, level AS high FROM a WHERE m = 1),
 b(t, level, idx, digest, m) AS (SELECT -1, 0, t, digest, count(*) OVER () FROM sub UNION ALL {_UP.format('b')}),
 runs AS (SELECT t, level, idx // 16 AS up, list(digest ORDER BY idx) AS kids FROM (FROM a UNION ALL FROM b) WHERE m > 1 GROUP BY ALL),
 p AS (SELECT doc_id, d.t, r.level, idx // (16 ** r.level)::BIGINT % 16 AS pos, kids FROM d JOIN runs r ON r.t = d.t AND r.up = idx // (16 ** (r.level + 1))::BIGINT
  UNION ALL SELECT doc_id, d.t, high + r.level, d.t // (16 ** r.level)::BIGINT % 16, kids FROM d JOIN sub USING (t) JOIN runs r ON r.t = -1 AND r.up = d.t // (16 ** (r.level + 1))::BIGINT),
 f(doc_id, level, digest) AS (SELECT doc_id, 0, other FROM d UNION ALL
  SELECT doc_id, level + 1, sha256(array_to_string(kids[:pos], '') || digest || array_to_string(kids[pos + 2:], '')) FROM f JOIN p USING (doc_id, level)),
 q AS (SELECT doc_id, max(level) + 1 AS levels, string_agg(array_to_string(kids[:pos], '') || array_to_string(kids[pos + 2:], ''), '' ORDER BY level) AS proof FROM p GROUP BY doc_id)
SELECT doc_id, leaf, sub.digest AS subroot, root.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.digest AS folded_root, f.digest = root.digest AS verified
FROM d JOIN sub USING (t) CROSS JOIN (SELECT digest FROM b WHERE m = 1) root LEFT JOIN q USING (doc_id) JOIN f ON f.doc_id = d.doc_id AND f.level = coalesce(levels, 0)
"""
