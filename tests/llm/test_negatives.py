import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, line int"


def slow(rows, modulo=50, relabel=True):
    seen, v = set(), []
    for i, x, y in rows:
        if i is None or x is None or y is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        y = (y + 1) % 10 if relabel and i % 7 == 0 else y
        whole = tuple(math.floor(256 * float(np.float32(c))) for c in x)
        if (i, y, whole) not in seen:
            seen.add((i, y, whole))
            v.append((i, y, whole))
    out = []
    for a, y, x in v:
        if a % modulo:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, z)), b, w) for b, w, z in v)
        for s, b, w in [t for t in scored if t[2] == y and t[1] != a][:5]:
            found = [(c, -n) for n, c, u in scored if u != y and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(a, b, k + 1, c, -s, n) for k, (c, n) in enumerate(found)]
    return sorted(out)


def vectors(n, dims, labels, seed, spread=0.4, ties=False):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(3)]
    draw = (lambda m: float(round(m))) if ties else (lambda m: m + rng.gauss(0, spread))
    return [(i, [draw(c) for c in centre[rng.randrange(3)]], rng.choice(labels)) for i in range(n)]


@pytest.mark.parametrize("n, dims, width, labels", [(150, 7, 3, [0, 1, 2, 9]), (260, 64, 32, [1] * 4 + [2, 3]), (120, 5, 8, [4])])
def test_equals_brute_force(spark, n, dims, width, labels):
    rows = vectors(n, dims, labels, n) + [(None, [1.0] * dims, 1), (3000, None, 1), (3050, [1.0] * dims, None), (3100, [float("nan")] * dims, 1), (3150, [None] + [1.0] * (dims - 1), 1), (3200, [math.inf] + [0.0] * (dims - 1), 1)]
    rows += rows[:5]  # equal rows
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df, F.col("id") % 50 == 0, label=label, anchor_rows=2, block_rows=16, width=width).collect()
    want = slow(rows)
    assert sorted(map(tuple, got)) == want and (want or labels == [4])


def test_ties_go_by_the_smaller_id(spark):
    rows = vectors(220, 6, [0, 1], 5, ties=True)
    df = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)
    got = negatives.hard_negatives(df, F.col("id") % 20 == 0, anchor_rows=4, block_rows=32, width=2).collect()
    want = slow(rows, 20, False)
    assert sorted(map(tuple, got)) == want and len(want) > 30


def test_nothing_and_huge_components(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(none, F.col("id") % 50 == 0).collect() == []
    rows = [(i, [3e38 if i % 2 else -3e38, 1.0], i % 3) for i in range(20)] + [(50, [], 1)]
    got = negatives.hard_negatives(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA), F.col("id") % 5 == 0).collect()
    assert all(abs(r.positive_score) <= 2**49 and 0 <= r.positive_score <= 2 * r.negative_score for r in got)


def test_wide_products_are_exact():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-(1 << 24), 1 << 24, (5, 64)).astype(np.int32) for _ in range(2))
    want = np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a])
    assert (negatives.product(a, b) == want).all() and len(negatives.narrow(want)) == 8 * 25


def test_op12_on_the_sample(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, negatives.op12_hard_negatives(spark, d).collect())) == slow(rows)


def test_tiles_stay_where_they_are(spark):
    """Neither tiles nor panels of rows are shuffled, and a share of the rows leaves no more than the best of each anchor."""
    df = spark.createDataFrame([(*r, "", 1) for r in vectors(300, 6, [0, 1], 7)], SCHEMA)
    got = negatives.hard_negatives(df, F.col("id") % 10 == 0, anchor_rows=4, block_rows=8, width=2)
    assert "FlatMapGroupsInArrow" not in got._jdf.queryExecution().toString()
    panel = negatives.Panel(np.zeros(1, np.int64).tobytes(), np.zeros(1, np.int64).tobytes(), [np.ones(2, np.int32).tobytes()], 2)
    kept = negatives.SameLabel(panel, (), 5)
    for k in range(40):
        row = negatives.Panel(np.arange(8 * k + 1, 8 * k + 9).tobytes(), np.zeros(8, np.int64).tobytes(), [np.full(16, k % 7, np.int32).tobytes()], 2)
        kept.add(row, panel.tile(row))
    assert kept.rows()["id"].tolist() == [49, 50, 51, 52, 53] and kept.rows()["score"].tolist() == [12] * 5
