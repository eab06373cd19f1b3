import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ctw, quality
from quillon.llm.base import held_fold

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def slow_scores(rows, depth):
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    count: dict = defaultdict(lambda: [0, 0])

    def steps(t):
        b = bytes([255]) * depth + (t or "").encode().translate(LOWER) + b"\xff"
        for i in range(depth, len(b)):
            yield b[i - depth : i][::-1], b[i]

    for _, t in train:
        for ctx, c in steps(t):
            for bit in range(8):
                for d in range(depth + 1):
                    count[ctx[:d], 1 << bit | c >> (8 - bit)][c >> (7 - bit) & 1] += 1
    below = defaultdict(set)
    for ctx, node in count:
        if ctx:
            below[ctx[:-1], node].add(ctx)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo: dict = {}

    def weighted(ctx, node):
        if (ctx, node) not in memo:
            own = kt(*count[ctx, node])
            memo[ctx, node] = own if len(ctx) == depth else float(np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(weighted(x, node) for x in below[ctx, node])))
        return memo[ctx, node]

    def p(ctx, node, bit, d=0):
        a, b = count.get((ctx[:d], node), (0, 0))
        here = ((a, b)[bit] + 0.5) / (a + b + 1)
        if d == depth or not a + b:  # no data here nor below: one half at every depth
            return here
        w = math.exp(math.log(0.5) + kt(a, b) - weighted(ctx[:d], node))
        return w * here + (1 - w) * p(ctx, node, bit, d + 1)

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    c = Counter(w for _, t in train for w in [*words(t), None])
    n, v, out = sum(c.values()), len(c), {}
    for i, t in rows:
        own = [*words(t), None]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out[i] = (i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(own), sum(c[w] > 0 for w in own), n, base, sum(math.log10(p(x, 1 << k | y >> (8 - k), y >> (7 - k) & 1)) for x, y in steps(t) for k in range(8)))
    return out


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_scores_are_brute_force(spark, sample, depth):
    rows = [(r.doc_id, (r.text or "")[:150]) for r in sample.orderBy("doc_id").limit(30).collect()] + [(501, None), (502, ""), (503, " \n"), (504, "É ünï"), (505, "A a A")]
    want = slow_scores(rows, depth)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ctw.language_scores(df, held_fold("doc_id", 5, 1), depth).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4]) and r.score == pytest.approx(w[5], rel=1e-6)
        assert r.bits_per_byte == pytest.approx(-w[5] * math.log2(10) / (len((dict(rows)[r.doc_id] or "").encode()) + 1), rel=1e-6)


def test_words_that_collide_under_polynomial_hashes_are_two(spark):
    t = "".join("er"[i.bit_count() & 1] for i in range(2048))
    df = spark.createDataFrame([(1, t), (2, t.translate(str.maketrans("er", "re")))], "doc_id long, text string")
    got = {r.doc_id: r.n_known for r in ctw.language_scores(df, F.col("doc_id") == 2, 2).collect()}
    assert got == {1: 2, 2: 1}


def test_next_byte_probabilities_sum_to_one():
    rng = random.Random(3)
    keys, counts = ctw.summed(np.array([int.from_bytes(bytes(rng.choice(b"abc") for _ in range(4)), "big") for _ in range(500)], np.uint64), np.ones(500, np.int64))
    context = int(keys[5]) >> 8 << 8
    every = np.array([context | b for b in range(256)], np.uint64)
    keys, counts = ctw.summed(np.concatenate((keys, every)), np.concatenate((counts, np.zeros(256, np.int64))))
    tree = ctw.Tree(keys, counts, 3)
    p = 10 ** tree.log10(ctw.Root(list(tree.tops())))
    assert p[np.isin(keys, every)].sum() == pytest.approx(1)


def test_log_kt_of_large_counts():
    a, b = np.array([0, 5, 5000, 10**7]), np.array([0, 0, 4095, 3])
    assert ctw.log_kt(a, b) == pytest.approx([math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a.tolist(), b.tolist())])


def test_scores_of_odd_tables(odd, nothing):
    got = ctw.language_scores(odd, held_fold("doc_id", 5, 1), 3).collect()
    assert len(got) == odd.count() and all(r.score < 0 and math.isfinite(r.base_score) for r in got)
    assert ctw.language_scores(nothing, held_fold("doc_id", 5, 1), 3).count() == 0
    untrained = ctw.language_scores(odd.filter("doc_id = 3"), F.lit(True), 3).first()
    assert untrained.train_tokens == 0 and untrained.n_known == 0 and untrained.score == pytest.approx(5 * 8 * math.log10(0.5))


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.op9_quality_classifier(spark, d)
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_classifier_learns_no_held_out_label(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = held_fold("doc_id", 4, 2)
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels, ~held) == quality.fit(docs, turned, ~held)


def test_classifier_odd_tables(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(odd, quality.fit(odd, none, F.lit(True))).collect()} == {0.5}
    one = spark.createDataFrame([(5, 1), (6, 1), (None, 0), (7, None)], "doc_id long, quality int")
    assert all(r.score > 0.7 for r in quality.score(odd, quality.fit(odd, one, F.lit(True))).collect())
    two = spark.createDataFrame([(5, 1), (6, 1), (9, 0), (10, 0), (9, 0)], "doc_id long, quality int")
    model = quality.fit(odd, two, F.lit(True))
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(nothing, model).count() == 0
    assert quality.accepted(odd, model).columns == odd.columns


def test_pipeline_runs_its_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs, names = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        names.append(docs.columns)
    assert all(n == names[0] for n in names) and names[0] == ["doc_id", "text", "lang", "source", "n_chars"]
    out = corpus_pipeline.run(spark, d).collect()
    assert 0 < len(out) < 200 and all(r.n_tokens == len(r.ids) for r in out)


def similar_groups(rows):
    """The rows whose component, by five-word shingles at a similarity of 0.8 or more, has no smaller id."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER).decode()) for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if z in (x, y) else z for z in label]
    return [r for i, r in enumerate(rows) if label[i] == i]


def without_known_windows(rows, span=50):
    first: dict = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - span + 1):
            first.setdefault(b[s : s + span], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - span + 1):
            if first[b[s : s + span]] < i:
                gone[s : s + span] = True
        out.append((i, bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")))
    return out


def test_pipeline_is_a_brute_force_chain(spark):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    import corpus_pipeline
    from quillon.llm import leaks

    d = "/root/testdata/sf0.001"
    docs = corpus_pipeline.good_documents(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    rows = without_known_windows(similar_groups(sorted((r.doc_id, r.text) for r in docs.collect())))
    items = [leaks.plain(r.text.encode()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    pairs = [(i, x, leaks.plain(t.encode())) for i, t in rows for x in items]
    edits, _ = leaks.distances([x for _, x, _ in pairs], [t for _, _, t in pairs])
    leaking = {i for (i, x, _), e in zip(pairs, edits.tolist()) if e <= int(len(x) * leaks.SHARE)}
    bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {i: bpe.encode_ordinary(t) for i, t in rows if i not in leaking}
    assert leaking and len(rows) < docs.count()
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, d).collect()} == want
