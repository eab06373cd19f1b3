import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import language
from quillon.llm.base import held_fold

D = language.DEPTH


def slow_trees(rows, grams=language.GRAMS):
    """For each language {context: Counter of next bytes}, of its most frequent grams."""
    count = defaultdict(Counter)
    for lang, text in rows:
        if lang is not None and text is not None:
            b = language.START + text.encode()
            count[lang].update(b[i - D : i + 1] for i in range(D, len(b)))
    out = {}
    for lang, c in count.items():
        if not c:
            continue
        tree = out[lang] = defaultdict(Counter)
        for g, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:grams]:
            for k in range(D + 1):
                tree[g[k:-1]][g[-1]] += n
    return out


def slow_bits(tree, text):
    b, bits = language.START + text.encode(), 0.0
    for i in range(D, len(b)):
        for k in range(D + 1):
            seen = tree.get(b[i - D + k : i])
            if seen and b[i] in seen:
                bits -= math.log2(seen[b[i]] / (sum(seen.values()) + len(seen)))
                break
            if seen:
                bits -= math.log2(len(seen) / (sum(seen.values()) + len(seen)))
        else:
            bits += 8
    return bits


TEXTS = {"en": "the quick brown fox jumps over the lazy dog and then the other fox ", "fr": "le renard brun saute par dessus le chien paresseux et puis l'autre été ", "de": "der schnelle braune fuchs springt über den faulen hund und dann der andere "}


def rows_of(n, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(TEXTS))
        words = TEXTS[lang].split()
        out.append((i, " ".join(rng.choices(words, k=rng.randrange(1, 30))), rng.choice([lang] * 9 + [None])))
    return out


@pytest.mark.parametrize("grams", [40, language.GRAMS])
def test_prices_equal_a_plain_tree(spark, monkeypatch, grams):
    monkeypatch.setattr(language, "STEP", 64)  # no effect in workers; pieces below is called here
    rows = rows_of(60) + [(1000, "x", "xx"), (1001, "", "empty"), (1002, None, "none")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(3)
    model = language.fit(df, held_fold("doc_id", 3, 1) == False, grams=grams)  # noqa: E712
    trees = slow_trees([(r[2], r[1]) for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1], grams)
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    total = {k: sum(t[b""].values()) for k, t in trees.items()}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        bits = {k: slow_bits(t, text) for k, t in trees.items()}
        cost = {k: b - math.log2(total[k] / sum(total.values())) for k, b in bits.items()}
        best = min(sorted(cost), key=cost.get)
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(2 ** (cost[best] - c) for c in cost.values()))
        assert got[i].bits_per_byte == pytest.approx(bits[best] / len(text.encode()))
    assert sum(got[r[0]].lang_pred == r[2] for r in rows if r[2] in TEXTS) > 45
    names, kept = language.read_trees(model.where, 0)
    long = "".join(r[1] for r in rows if r[1]) + "É"
    assert kept[0].prices(next(language.pieces([long.encode()]))[0][:0]).sum() == 0
    whole = sum(float(kept[names.index("fr")].prices(c).sum()) for c, _ in language.pieces([b"", long.encode(), b""]))
    assert whole == pytest.approx(slow_bits(trees["fr"], long))


def test_many_languages_in_groups(spark):
    rows = [(i, chr(97 + i % 26) * 9 + " " + chr(97 + i * 7 % 26) * 5, chr(97 + i % 26)) for i in range(260)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, F.lit(True), group=4)
    assert model.groups == 7
    got = {r.doc_id: r.lang_pred for r in language.predict(df, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_odd_rows_and_nothing(spark, odd, nothing):
    docs = odd.withColumn("lang", F.when(F.col("doc_id") == 3, "en").when(F.col("doc_id") == 6, "xx"))
    got = language.predict(docs, language.fit(docs, F.lit(True)), keep=("block",)).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got} == {"und", "en", "xx"}
    assert all(0 <= r.score <= 1 for r in got)
    empty = language.fit(nothing, F.lit(True))
    assert language.predict(nothing, empty).collect() == []
    assert {(r.lang_pred, r.score) for r in language.predict(odd, empty).collect()} == {("und", 0.0)}
    with pytest.raises(ValueError):
        language.predict(odd, empty, keep=("score",))


def test_op11_on_held_out_rows(spark, sample):
    got = {r.doc_id: r for r in language.op11_language_id(spark, "/root/testdata/sf0.001").collect()}
    held = [r for r in sample.collect() if got[r.doc_id].held_out and r.lang is not None and got[r.doc_id].lang_pred != "und"]
    assert len(held) > 40 and sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
