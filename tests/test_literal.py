import random

import pytest
from pyspark.sql import functions as F

from quillon.plans import literal as L
from quillon.plans import scan as S
from quillon.plans.corpus import with_paths
from quillon.plans.regex import regex_scan

RNG = random.Random(7)
PARTS = ["tern", "Ternary", "petrel", "STRASSE", "Straße", "straẞe", "Kelvin", "kelvin", "ſkua", "Skua", "İstanbul", "istanbul", "ΟΔΟΣ", "οδος", "été", "a-b_c", "x" * 200 + "middle" + "y" * 200, *["tern petrel"] * 4, "no break"]
ROWS = [(i, f"/n/{RNG.choice(['tern', 'log', 'Deck 2'])}{i}.txt", RNG.choice([" ", "\n", " \t "]).join(RNG.choices(PARTS, k=RNG.randrange(1, 12)))) for i in range(120)]
ROWS += [(500, "/n/none.txt", None), (501, "/n/blank.txt", " \n "), (502, "/n/petrel.md", "")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = with_paths(spark.createDataFrame(ROWS, "doc_id long, path string, content string"))
    df = df.selectExpr("*", "'' as meta", "coalesce(octet_length(content), 0) as size", "1700000000 - doc_id as mtime", "'text' as kind").repartition(3).cache()
    where = f"file://{tmp_path_factory.mktemp('literals')}"
    L.write(df, where)
    return L.LiteralIndex(df, where)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.mark.parametrize("text", ["tern", "ernar", "strasse", "STRAßE", "Kelvin", "skua", "istanbul", "οδος", "ÉTÉ", "a-b", "middle", "tern petrel", "kua k", "zzz", "no", "ext:md petrel", "x" * 100, " "])
def test_exact_equals_the_scan(index, text):
    for options in ({}, {"case_sensitive": True}, {"whole_word": True}):
        assert ids(L.exact(index, text, **options)) == ids(S.exact(index.docs, text, **options))


@pytest.mark.parametrize("text", ["tern[a-z]+", r"pet\w+", "(tern|kelvin) ", "k.lvin", "s+kua", "[^a]{3}", "ext:md petre"])
def test_regex_equals_the_scan(index, text):
    assert ids(L.regex(index, text)) == ids(regex_scan(index.docs, text))


@pytest.mark.parametrize("text", ["tern", "tern1", "*2.txt", "t?rn*", "deck 2", "none", "zzzz", "ext:md petrel"])
def test_names_equal_the_scan(index, text):
    assert ids(L.filename(index, text)) == ids(S.filename(index.docs, text))


def test_name_score_counts_whole_words(index):
    rows = {r.name: r.score for r in L.filename(index, "petrel").collect()}
    assert rows == {"petrel.md": 1}


def test_pages_are_the_full_sort_and_verify_fewer(index):
    literal = "tern petrel"
    hits = set(ids(S.exact(index.docs, literal)))
    posts = index.postings(["tern", "petrel"]).groupBy("doc_id", "part").agg(F.max("level").alias("level")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("level").alias("score")).filter("n = 2").collect()
    want = [(r.doc_id, float(r.score)) for r in sorted(posts, key=lambda r: (-r.score, r.doc_id)) if r.doc_id in hits]
    assert len(want) > 8
    got, more = L.exact_page(index, literal, limit=3, batch=2)
    assert [tuple(r) for r in got.collect()] == want[:3] and more
    got, more = L.exact_page(index, literal, limit=4, offset=2, batch=3)
    assert [tuple(r) for r in got.collect()] == want[2:6] and more
    got, more = L.exact_page(index, literal, limit=500, batch=4)
    assert [tuple(r) for r in got.collect()] == want and not more
    got, more = L.regex_page(index, "tern", limit=2, batch=4)
    assert got.count() == 2 and more and index.verified < len(ids(regex_scan(index.docs, "tern")))


def test_pages_in_other_orders(index):
    hits = ids(S.exact(index.docs, "tern"))
    got, _ = L.exact_page(index, "tern", limit=5, sort="modified", batch=4)
    assert [r.doc_id for r in got.collect()] == hits[:5]  # the time falls with the number
    assert index.verified < len(hits)
    got, more = L.regex_page(index, ".", limit=4, batch=3)  # no literal: every document is a candidate
    assert [r.doc_id for r in got.collect()] == ids(regex_scan(index.docs, "."))[:4] and more
    got, more = L.exact_page(index, "zzz", limit=4)
    assert got.count() == 0 and not more


def test_only_row_groups_of_the_gram_are_read(index):
    plan = index.words_with("petrel")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(gram," in plan


def test_words_of_unique_documents_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "b a B", "1.txt"), (2, None, "2.txt"), (3, "x" * 200 + " a", "3.txt")], "doc_id long, content string, name string")
    found = L.words(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.field, r.doc_id, r.word): (r.tf, r.n) for r in found.collect()}
    assert got["content", 1, "b"] == (2, 3) and got["content", 1, "a"] == (1, 3) and got["content", 3, "a"] == (1, 2)
    assert got["content", 3, "x" * 128][1] == 2  # pieces that overlap by half
    assert {k for k in got if k[0] == "name"} == {("name", i, f"{i}.txt") for i in (1, 2, 3)}
    twice = L.words(docs.unionByName(docs.filter("doc_id = 1")))
    assert {(r.word, r.tf) for r in twice.filter("doc_id = 1 AND field = 'content'").collect()} == {("b", 4), ("a", 2)}


def test_posts_have_a_row_for_each_word_of_a_block(index):
    assert index.posts.count() < index.posts.selectExpr("sum(size(docs))").first()[0] / 4
    got = index.posts.filter("field = 'content'").selectExpr("word", "explode(docs) as doc_id").collect()
    want = L.words(index.docs).filter("field = 'content'").collect()
    assert sorted((r.word, r.doc_id) for r in got) == sorted((r.word, r.doc_id) for r in want)


def test_posts_are_read_once_for_all_literals(index):
    plan = index.postings(["tern", "petrel", "kelvin"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("docs#") and sum("Relation" in line and "levels#" in line for line in plan.splitlines()) == 1
    assert "SortMergeJoin" not in index.postings(["tern", "petrel"])._jdf.queryExecution().executedPlan().toString()


def test_many_candidates_are_verified_where_they_are(index, monkeypatch):
    want = [tuple(r) for r in L.exact_page(index, "tern petrel", limit=500)[0].collect()]
    monkeypatch.setattr(L, "LARGEST", 3)
    for batch in (2, 5):  # after a batch, and from the start
        got, more = L.exact_page(index, "tern petrel", limit=6, offset=2, batch=batch)
        assert [tuple(r) for r in got.collect()] == want[2:8] and more
    got, more = L.exact_page(index, "tern petrel", limit=500, batch=2)
    assert [tuple(r) for r in got.collect()] == want and not more


def test_index_of_repeated_documents(spark, tmp_path):
    from quillon.plans.corpus import with_paths

    rows = [(1, "/a/1.txt", "tern a b c"), (1, "/a/1.txt", "tern d"), (2, "/a/2.txt", "tern"), (3, "/a/3.txt", "\u0307 \u0307x")]
    docs = with_paths(spark.createDataFrame(rows, "doc_id long, path string, content string"))
    L.write(docs, f"file://{tmp_path}")
    level = {r.doc_id: r.level for r in L.LiteralIndex(docs, f"file://{tmp_path}").postings(["tern"]).collect()}
    average = (6 + 1 + 1) / 3  # a word of nothing but a dot is none
    assert level == {i: int(100 * tf / (tf + 1.2 * (0.25 + 0.75 * n / average))) for i, tf, n in ((1, 2, 6), (2, 1, 1))}


def test_grams_and_counts_of_words(spark):
    import pyarrow as pa

    texts = pa.array(["b a\x0b b ", None, "", "x" * 200 + " a"])
    code, row, tf, words, n = L.counted(texts)
    got = {(words[c].as_py(), r): t for c, r, t in zip(code.tolist(), row.tolist(), tf.tolist())}
    assert got == {("b", 0): 2, ("a", 0): 1, ("x" * 128, 3): 2, ("x" * 72, 3): 1, ("a", 3): 1}
    assert n.tolist() == [3, 0, 0, 2] == L.sizes(texts).tolist()
    gram, first, of = L.grams_of(pa.array(["aaaa", "ab", "baaa", "𝔘é\U0010ffff"]))
    assert {g: of[a:b].tolist() for g, a, b in zip(gram, first, first[1:])} == {"aaa": [0, 2], "baa": [2], "𝔘é\U0010ffff": [3]}
    assert L.grams_of(pa.array([], pa.string()))[0] == []
