from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import text as T


def test_words_split_at_punctuation_and_keep_marks():
    t = "foo_bar-baz.qux 東京 café " + "x" * 65 + " end"
    assert [t[a:b] for a, b in T.spans(t)] == ["foo", "bar", "baz", "qux", "東", "京", "café", "end"]


def test_normalize():
    assert [T.normalize(w) for w in ("Straße", "Æsir", "ŁÓDŹ", "Ðor", "İstanbul", "Œuvre", "كتـاب", "مدرسة", "١٢۳")] == ["strasse", "aesir", "lodz", "dor", "istanbul", "oeuvre", "كتاب", "مدرسه", "123"]


def test_articles():
    assert T.without_article("الكتاب") == "كتاب"
    assert T.without_article("والكتاب") == "كتاب"
    assert T.without_article("الم") == "الم"  # too short without it
    assert T.index_tokens("الكتاب جديد") == [(0, "الكتاب"), (0, "كتاب"), (1, "جديد")]
    assert T.query_tokens("الكتاب") == ["كتاب"]


def test_columns_agree_with_python_on_latin(spark):
    texts = ["Café au lait, Straße_12", None, "", "ÀÉÎÕÜ ñandú œuf", "Don't stop-me.now " + "y" * 70]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokens(F.col("t"))).collect()]
    assert got == [[T.normalize(t[a:b]) for a, b in T.spans(t)] if t else [] for t in texts]


def test_arrow_tokenizer(spark):
    got = spark.createDataFrame([("東京 Tower",), (None,)], "t string").select(T.positions_udf()("t")).collect()
    assert [[tuple(x) for x in r[0]] for r in got] == [[(0, "東"), (1, "京"), (2, "tower")], []]


@given(st.text(alphabet="ab*?.[(\\", max_size=8), st.text(alphabet="ab.[(\\\n", max_size=8))
def test_glob(pattern, name):
    import fnmatch
    import re

    want = re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), name, re.S) is not None
    assert (re.match(T.glob_regex(pattern), name) is not None and re.fullmatch(T.glob_regex(pattern)[1:-1], name) is not None) == want
    assert fnmatch  # the standard module treats brackets otherwise


def test_extension(spark):
    rows = spark.createDataFrame([("a.TXT",), ("a",), (".bashrc",), ("a.tar.gz",)], "n string").select(T.extension(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["txt", "", "", "gz"]
