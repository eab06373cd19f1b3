import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def path(tree, i):
    for nodes in tree[:-1]:
        yield i % 16, nodes[i // 16 * 16 :][:16]
        i //= 16


def slow(rows):
    """(doc_id, leaf) to (subroot, root, proof, folded, verified), from whole trees in memory."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r[:5]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = {}
    for k, s in enumerate(order):
        for i, (_, _, mine, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = [*path(trees[s], i), *path(top, k)]
            folded = leaf([*r[:4], r[4] and r[4].translate(LOWER)]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else mine
            for pos, kids in steps:
                folded = h("".join([*kids[:pos], folded, *kids[pos + 1 :]]))
            proof = h("".join("".join(kids[:pos] + kids[pos + 1 :]) for pos, kids in steps))
            out.setdefault((r[0], mine), set()).add((trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def rows_of(sizes, seed=1):
    rng, out = random.Random(seed), []
    for source, n in sizes.items():
        out += [(len(out) + i, source, rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "Ünï Cödé A", f"text {i}", "LOUD"]), "clash") for i in range(n)]
    rng.shuffle(out)
    return out


def check(got, want):
    assert sum(map(len, want.values())) <= len(got)
    for r in got:
        assert (r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) in want[r.doc_id, r.leaf]


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "a": 1}, {"a": 16}, {"a": 17, "b": 2}, {None: 33, "": 1, "é": 260, "z": 16, "hot": 600}, {f"s{i:02}": 1 + i % 3 for i in range(40)}])
@pytest.mark.parametrize("deep", [1, 3])
def test_merkle_equals_whole_trees(spark, sizes, deep):
    rows = rows_of(sizes)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = merkle.manifest(docs, tampered=text, paths=True, levels=deep).collect()
    assert len(got) == len(rows)
    check(got, slow(rows))
    for r in got:
        steps = [(p.pos, p.kids) for p in r.path]
        assert merkle.fold(r.leaf, steps) == r.root and h(merkle.siblings(steps)) == r.proof_sha256


def test_merkle_repeated_rows_null_ids_and_nothing(spark, nothing):
    rows = [(None, "a", None, None, None, ""), (None, "a", "en", 1, "x", ""), (3, "a", None, None, "B", ""), (3, "a", None, None, "A", ""), (3, "a", None, None, "A", ""), (1, "a", None, None, "y" * 300_000, "")]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and all(r.verified for r in got) and len({r.root for r in got}) == 1
    order = sorted(((r[0] is not None, r[0] or 0, leaf(r[:5])) for r in rows))
    assert got[0].root == h("".join(x[2] for x in order))
    assert merkle.manifest(nothing).collect() == []


def test_merkle_changed_leaf_is_not_verified(spark):
    docs = spark.createDataFrame(rows_of({"a": 40, "b": 3}), SCHEMA)
    got = merkle.manifest(docs, tampered=F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).collect()
    assert not any(r.verified for r in got)


def test_op13_on_the_sample(spark, sample):
    rows = [(*r, "") for r in sample.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = merkle.op13_merkle(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    check(got, slow(rows))


def test_traversal_keeps_two_subtrees_a_level():
    leaves = [h(str(i)) for i in range(700)]
    tree, walk = levels(leaves), merkle.Traversal(leaves, 3)
    for i, steps in enumerate(walk):
        assert steps == list(path(tree, i))
        assert all(sum(map(len, d.runs)) <= 16 * (k + 1) for k, d in enumerate(walk.desired))
