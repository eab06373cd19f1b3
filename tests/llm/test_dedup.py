import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillon.llm import leaks, simhash, suffix
from quillon.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def slow_fingerprint(t, k=4):
    w = WORD.findall(lower(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps):
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(ids[a]), find(ids[b])
                label[max(x, y)] = min(x, y)
    return [find(i) for i in ids]


@pytest.mark.parametrize("bucket", [20, simhash.BUCKET])
def test_simhash_is_brute_force(sample, bucket):
    rows = sorted((r.doc_id, r.text) for r in sample.collect())
    fps = [slow_fingerprint(t) for _, t in rows]
    want = list(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], slow_components([i for i, _ in rows], fps)))
    assert sorted(map(tuple, simhash.near_duplicates(sample, bucket=bucket).collect())) == want


def test_simhash_links_chains_in_large_buckets(spark):
    rng = random.Random(5)
    fps, at = [], rng.getrandbits(64)
    for _ in range(60):  # a chain of near fingerprints, among others
        fps.append(at)
        for b in rng.sample(range(64), 4):
            at ^= 1 << b
    fps += [rng.getrandbits(64) for _ in range(50)] + [fps[0], 0, (1 << 64) - 1, (1 << 64) - 2]
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for bucket in (12, 1000):
        label = {f: f for f in fps}

        def find(x, label=label):
            while label[x] != x:
                x = label[x]
            return x

        for r in simhash.links(df, bucket).collect():
            a, b = find(r.a % (1 << 64)), find(r.b % (1 << 64))
            label[max(a, b)] = min(a, b)
        assert [find(f) for f in fps] == slow_components(fps, fps)


def test_masks_meet_every_near_pair():
    rng = random.Random(1)
    for agreed in (0, simhash.masks()[3], simhash.masks(simhash.masks()[7])[2]):
        free = [i for i in range(64) if not agreed >> i & 1]
        for _ in range(200):
            x = sum(1 << i for i in rng.sample(free, 4))
            assert any(x & m == 0 for m in simhash.masks(agreed))


def test_simhash_odd_rows(odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].fingerprint == "0" * 16 and {by[i].component_id for i in (0, 1, 2)} == {0}
    assert by[6].component_id == 5 or by[6].fingerprint != by[5].fingerprint or by[6].component_id == by[5].component_id
    assert by[10].component_id == by[9].component_id and [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(nothing).count() == 0
    left = simhash.distinct_documents(odd)
    assert left.columns == odd.columns and {1, 2, 10}.isdisjoint({r.doc_id for r in left.collect()}) and left.filter("doc_id is null").count() == 1


def test_stage_keeps_one_of_each_similar_group(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(120))) for i in range(12)]
    for i in range(12, 60):  # copies with a few words changed, at similarities about 0.8
        words = rows[rng.randrange(i)][1].split()
        for at in rng.sample(range(len(words)), rng.randint(1, 4)):
            words[at] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(70, None), (71, " "), (72, "one two"), (73, "One  two"), (74, "two one")]
    sets = []
    for _, t in rows:
        w = lower(t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    middle = 0
    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            middle += 0.8 * either <= both < 0.9 * either
            if both >= 0.8 * either:
                label = [label[b] if x == label[a] else x for x in label]
    want = {x: i for i, x in reversed(list(zip([i for i, _ in rows], label)))}
    left = simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert middle >= 10 and {r.doc_id for r in left} == set(want.values())


def test_stage_makes_few_pairs_of_a_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = [(i, " ".join(base)) for i in (0, 400)]
    for i in range(1, 400):  # one to ten words changed: some are similar to the first one, the others to nearly none
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randint(1, 10)):
            words[at] = f"n{rng.randrange(200)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in sorted(rows))]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    made, similar = [], simhash.similar

    def counted(pairs, *more):
        made.append(pairs.count())
        return similar(pairs, *more)

    monkeypatch.setattr(simhash, "similar", counted)
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    alone = sum(find(i) == i for i in range(1, 400))
    assert 80 < alone < 320 and sorted(map(tuple, got)) == [(i, find(i)) for i in range(401)]
    assert made[-1] < 10 * len(rows)  # 17,701 where all that are left in a bucket are compared


def test_rare_shingles_meet_every_similar_pair():
    rng = np.random.default_rng(3)
    base, sets = rng.integers(1, 1 << 63, 120, np.uint64), []
    for i in range(150):
        some = rng.choice(base, rng.integers(90, 121), replace=False)
        sets.append(np.unique(np.concatenate((some, rng.integers(1, 60, rng.integers(0, 25), np.uint64)))))
    sets += [np.unique(rng.choice(sets[i % 150], int(0.9 * len(sets[i % 150])), replace=False)) for i in range(20)]
    sets += [np.zeros(0, np.uint64), base[:1], base[:1], rng.integers(1, 1 << 63, 9, np.uint64)]
    label = rng.integers(0, 40, len(sets))
    token, df = np.unique(np.concatenate(sets), return_counts=True)
    counts = pa.table({"token": token.view(np.int64)[df > 1], "df": df[df > 1]})
    table = pa.table({"key": np.arange(len(sets)), "sketch": pa.array([[0] * simhash.SKETCHES] * len(sets), pa.list_(pa.int64())), "shingles": [x.tobytes() for x in sets]})
    parts = [simhash.prefixes(table.slice(lo, 50), counts, 0.8) for lo in range(0, len(sets), 50)]  # as of several blocks
    rows = pa.concat_tables([*parts, simhash.prefixes(table, counts.slice(0, 0), 0.8)])
    rows = rows.append_column("label", pa.array(label[rows.column("key").to_numpy()])).sort_by("token").combine_chunks()
    for size in (7, 1000):
        got = {(a, b) for x in simhash.meet(iter(rows.to_batches(size)), 0.8) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())}
        want = set()
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                both = len(np.intersect1d(sets[a], sets[b]))
                if label[a] != label[b] and len(sets[a]) and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                    want.add((a, b))
        assert len(want) > 50 and want <= got and all(label[a] != label[b] for a, b in got)


def test_components_of_a_long_path_and_a_star(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(1000, i) for i in range(1001, 1040)] + [(7, 7), (3, 2), (2000, 1999)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {i: 1000 for i in range(1000, 1040)} | {1999: 1999, 2000: 1999}


def slow_dedup(rows, span):
    first: dict = {}
    for i, t in rows:
        for s in range(len(t) - span + 1):
            w = t[s : s + span]
            first[w] = min(first.get(w, 1 << 63), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - span + 1):
            if first[t[s : s + span]] < i:
                gone[s : s + span] = b"\1" * span
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [suffix.HOT, 4])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcd ") for _ in range(300)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [b[a : a + rng.randint(20, 160)] for b in rng.sample(base, 2) for a in [rng.randrange(200)]]
        rows.append((i, rng.choice(["", "é", "x" * rng.randint(0, 120)]) + "-".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "z" * 49), (103, "z" * 50), (104, "z" * 200), (105, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = slow_dedup([(i, t.encode()) for i, t in rows], 50)
    assert sorted(map(tuple, suffix.deduplicated(df, texts=False).collect())) == want
    # small suffix arrays, which are merged, and small hash buffers
    parts = suffix.least_ids
    a = np.frombuffer(b"abcabcabdabc", np.uint8)
    every = np.arange(10)
    one = parts([(a, every, np.arange(10, 20))], 3)[0]
    two = parts([(a[:6].copy(), np.arange(4), np.arange(10, 14)), (a[4:].copy(), np.arange(6), np.arange(14, 20))], 3)
    assert one.tolist() == [*two[0].tolist(), *two[1].tolist()]


def test_shards_split_and_merge():
    rng = random.Random(9)
    frags = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(12, 20))) for _ in range(60)})
    rows = []
    for block in range(3):
        some = rng.sample(frags, 30)
        rows.append((block, suffix.pack(np.arange(30, dtype=np.uint32), np.array([rng.randrange(99) for _ in some]), np.array([len(f) for f in some], np.uint32), np.zeros(30, np.uint64), np.frombuffer(b"".join(some), np.uint8))))
    least: dict = {}
    for _, data in rows:
        _, low, size, _, text = suffix.unpack(data)
        at = 0
        for d, n in zip(low.tolist(), size.tolist()):
            for s in range(n - 9):
                w = text.tobytes()[at + s : at + s + 10]
                least[w] = min(least.get(w, 99), d)
            at += n
    for part in (40, 10_000):
        for (block, data), (_, sent) in zip(suffix.shard_windows(rows, 10, part), rows):
            ids, size, low = suffix.unpack(data)
            text, at, want = suffix.unpack(sent)[4].tobytes(), 0, []
            for n in size.tolist():
                want += [least[text[at + s : at + s + 10]] for s in range(n - 9)]
                at += n
            assert low.tolist() == want and block == _


def test_kinds_are_equal_parts():
    rng = random.Random(1)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 30))) for _ in range(20)] * 3
    rng.shuffle(parts)
    size = np.array([len(p) for p in parts])
    kind, some = suffix.kinds_of(suffix.eights(np.frombuffer(b"".join(parts), np.uint8)), np.cumsum(size) - size, size)
    assert len(some) == len(set(parts)) and all(parts[some[k]] == p for k, p in zip(kind.tolist(), parts))


def test_texts_longer_than_a_hash_buffer(spark, monkeypatch):
    """Parts of long texts overlap by less than a window, so that each window is met once."""
    monkeypatch.setattr(suffix, "SUB", 300)
    rng = random.Random(2)
    base = "".join(rng.choice("abcdef") for _ in range(3000))
    rows = [(1, base), (2, base[1000:2500] + "x" + base[:700]), (3, "".join(rng.choice("abcdef") for _ in range(900)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    segs = [(base_ + lo - starts[d], seg) for seg, (buf, _, offs, starts) in enumerate(suffix.segments([t.encode() for _, t in rows], 50)) for d, base_ in enumerate(offs.tolist()) for lo in range(starts[d], starts[d + 1] - 49)]
    assert len(segs) == sum(len(t) - 49 for _, t in rows)
    assert sorted(map(tuple, suffix.deduplicated(df, texts=False).collect())) == slow_dedup([(i, t.encode()) for i, t in rows], 50)


@pytest.mark.parametrize("n, letters", [(1, 2), (500, 1), (3000, 2), (3000, 4)])
def test_suffix_array_and_prefixes(n, letters):
    buf = np.random.default_rng(n).integers(97, 97 + letters, n, dtype=np.uint8)
    raw = buf.tobytes()
    buf[: n // 3] -= 97  # with bytes of zero
    raw = buf.tobytes()
    order = suffix.suffix_array(buf)
    assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
    lcp = suffix.common_prefixes(buf, order, 50).tolist()
    for k in range(1, n):
        a, b = raw[order[k] :][:50], raw[order[k - 1] :][:50]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_suffix_odd_rows(odd, nothing):
    got = suffix.deduplicated(odd, keep=("n_tokens",), spans=True).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[10].n_removed == by[9].n_bytes and by[10].text == "" and by[9].n_removed == 0 and by[0].n_bytes == 0
    assert [(s.start, s.end) for s in by[10].spans] == [(0, by[10].n_bytes)]
    assert suffix.deduplicated(nothing).count() == 0
    with pytest.raises(ValueError):
        suffix.deduplicated(odd.withColumnRenamed("score", "n_bytes"), keep=("n_bytes",))


def test_cut_characters_do_not_break_the_text(spark):
    shared = "ö" * 30
    df = spark.createDataFrame([(1, "a" + shared), (2, "é" + shared + "ü")], "doc_id long, text string")
    # the last window ends within the u umlaut, whose first byte goes with it
    assert {r.doc_id: (r.text, r.n_removed) for r in suffix.deduplicated(df).collect()} == {1: ("a" + shared, 0), 2: ("é", 61)}


def slow_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row), row.index(min(row))


def test_distances():
    rng = random.Random(6)
    pairs = [(bytes(rng.choice(b"abc") for _ in range(rng.choice([1, 5, 63, 64, 65, 130]))), bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 150)))) for _ in range(60)]
    e, end = leaks.distances([p for p, _ in pairs], [t for _, t in pairs])
    assert list(zip(e.tolist(), end.tolist())) == [slow_distance(p, t) for p, t in pairs]


def test_leaks_recall_and_silence(spark):
    rng = random.Random(8)
    items = [(r.item_id, leaks.plain(r.text.encode())) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    hosts = [r.text.encode()[:300] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) > 400").limit(40).collect()]
    m = leaks.Matcher(items, leaks.SHARE, leaks.RECALL)
    found = total = 0
    for i, t in items:
        for rate in (0, 0.05, 0.1):
            b = bytearray(t)
            for _ in range(int(len(t) * rate)):
                at = rng.randrange(len(b))
                b[at : at + 1] = rng.choice([b"", b"#", bytes(b[at : at + 1]) + b"#"])
            host = rng.choice(hosts)
            (got,) = m.find([host + b" \n" + bytes(b).upper() + b"\t" + host])
            total += 1
            hit = [g for g in got if g["item_id"] == i]
            found += bool(hit)
            assert not hit or hit[0]["edits"] <= int(len(t) * rate) + 5  # white space that meets becomes one
    assert found >= 0.97 * total


def spread_edits(rng, t, rate, how):
    """t with at most ``rate`` of its bytes edited: at even distances, one in each word, or anywhere."""
    most, b = int(len(t) * rate), bytearray(t)
    if how == "even":
        at = [int((k + 0.5) * len(t) / most) for k in range(most)]
    elif how == "words":
        ends = [m.end() for m in re.finditer(rb"\S+", t)]
        at = sorted(rng.randrange(t.rfind(b" ", 0, e - 1) + 1, e) for e in rng.sample(ends, min(most, len(ends))))
    else:
        at = sorted(rng.sample(range(len(t)), most))
    for k in reversed(at):
        b[k : k + 1] = rng.choice([b"", b"#", b[k : k + 1] + b"#"]) if how != "even" else b"#"
    return bytes(b)


@pytest.mark.parametrize("how", ["even", "words", "anywhere"])
@pytest.mark.parametrize("rate", [1 / 12, 1 / 8, 1 / 6, leaks.SHARE])
def test_leaks_are_brute_force_up_to_the_share(spark, how, rate):
    rng = random.Random(11)
    items = [(r.item_id, leaks.plain(r.text.encode())) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12).collect()]
    items += [(900 + k, leaks.plain(t)) for k, t in enumerate([b"ab", b"a b c", b"nine byte", b"twelve bytes", b"thirty bytes of text, or nearly"])]
    host = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) > 400").first().text.encode()[:150]
    texts = [host + b" " + spread_edits(rng, t, rate, how) + b" " + host[:80] for _, t in items] + [host, b"", b"\0\0"]
    m = leaks.Matcher(items, leaks.SHARE, leaks.RECALL)
    own = 0
    for k, (text, got) in enumerate(zip(texts, m.find(texts))):
        edits, ends = leaks.distances([t for _, t in items], [leaks.plain(text)] * len(items))
        want = [(i, e, end) for (i, t), e, end in zip(items, edits.tolist(), ends.tolist()) if e <= int(len(t) * leaks.SHARE)]
        assert sorted((g["item_id"], g["edits"], g["end"]) for g in got) == sorted(want)
        own += k < len(items) and any(g["item_id"] == items[k][0] for g in got)
    assert own >= 0.9 * len(items)


@pytest.mark.parametrize("share", [0.0, 0.02, 0.2, 0.35])
def test_leaks_in_texts_of_few_letters(share):
    rng = random.Random(3)
    items = [(i, leaks.plain(bytes(rng.choice(b"abcdefgh ") for _ in range(rng.choice([1, 2, 5, 11, 40, 90, 300]))).strip() or b"a")) for i in range(25)]
    texts = [b"".join(rng.choice([t, spread_edits(rng, t, share, "anywhere"), b" abc "]) for _, t in rng.sample(items, 4)) for _ in range(12)]
    for text, got in zip(texts, leaks.Matcher(items, share, leaks.RECALL).find(texts)):
        edits, ends = leaks.distances([t for _, t in items], [leaks.plain(text)] * len(items))
        want = {i: x for (i, _), x in zip(items, zip(edits.tolist(), ends.tolist()))}
        assert {g["item_id"]: (g["edits"], g["end"]) for g in got} == {i: x for i, x in want.items() if x[0] <= int(len(dict(items)[i]) * share)}


def test_leaks_tables(spark, odd, nothing):
    items = spark.createDataFrame([(1, "same text here and there same text"), (2, "same text here and there same text"), (3, None), (4, " "), (None, "word")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits) for r in leaks.leaks(odd, items).collect())
    assert got == [(9, 1, 0), (9, 2, 0), (10, 1, 0), (10, 2, 0)]
    left = leaks.clean(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 2
    assert leaks.leaks(nothing, items).count() == 0 and leaks.leaks(odd, items.limit(0)).count() == 0
    assert leaks.clean(odd, items.limit(0)).count() == odd.count()
