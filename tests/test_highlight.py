import pytest
from pyspark.sql import functions as F

from quillon.functions import excerpt as X
from quillon.functions import query as Q
from quillon.functions import text as T
from quillon.plans import highlight as H
from quillon.plans import index as I
from quillon.plans.corpus import with_paths
from quillon.plans.regex import compiled, regex_scan
from quillon.sources.kinds import kind_of

TEXT = "Total of\nthe total; totalling été, l'été 2024.\nTOTAL of the end"


def shown(mode, query, text=TEXT, **options):
    return [text[a:b] for a, b in H.highlighter(mode, query, **options).spans([text])[0]]


def test_spans_of_all_modes():
    assert shown("smart", "total") == ["Total", "total", "totalling", "TOTAL"]
    assert shown("smart", "total", whole_word=True) == ["Total", "total", "TOTAL"]
    assert shown("smart", '"of the" -end') == ["of\nthe", "of the"]
    assert shown("exact", "of the") == ["of\nthe", "of the"]
    assert shown("exact", "total", case_sensitive=True) == ["total", "total"]
    assert shown("exact", "total", whole_word=True) == ["Total", "total", "TOTAL"]
    assert shown("regex", r"\w+é") == ["été", "été"] and shown("regex", "t[a-z]+l", whole_word=True) == ["Total", "total", "TOTAL"]
    assert shown("regex", "(t(o)t)al", "total") == ["total"] and shown("regex", "x*") == []
    assert shown("filename", "total") == [] and shown("exact", " ") == [] and shown("regex", "ext:txt") == []
    assert shown("exact", "aa", "aa aaa aa", whole_word=True) == ["aa", "aa"]


def test_marks_do_not_meet_private_characters():
    text = "a b"
    assert shown("exact", "a", text) == ["a"] and H.highlighter("regex", "[ab]").spans([text, ""])[0] == [(1, 2), (4, 5)]


def test_snippets_and_previews_come_from_executors(spark):
    rows = [("/a", TEXT, None), ("/b", "nothing here", None), ("/c", None, None), ("/d", "x\n" * 5 + "total", [(0, "Page", 3, "")])]
    df = spark.createDataFrame(rows, "path string, content string, anchors array<struct<offset:int,kind:string,num:int,label:string>>")
    got = {r.path: r.snippets.asDict(True) for r in H.shown(df, H.highlighter("exact", "total")).collect()}
    spans = H.highlighter("exact", "total").spans([TEXT])[0]
    assert got["/a"] == X.of_spans(TEXT, spans) and got["/a"]["count"] == 4
    assert got["/b"]["snippets"] == [{"text": "nothing here", "highlights": [], "location": ""}] and got["/c"]["snippets"] == []
    assert got["/d"]["snippets"][0]["location"] == "Page 3"
    whole = {r.path: r.preview.asDict(True) for r in H.shown(df, H.highlighter("regex", "tot[a-z]+"), "preview").collect()}
    assert whole["/a"]["total"] == 4 and whole["/b"] == {"sections": [], "total": 0, "capped": False}


def test_an_own_highlighter(spark):
    class Digits:
        def spans(self, texts):
            return [[(i, i + 1) for i, c in enumerate(t) if c.isdigit()] for t in texts]

    df = spark.createDataFrame([("/a", "a1b2")], "path string, content string")
    assert [(s.start, s.end) for s in H.shown(df, Digits(), "spans").first().spans] == [(1, 2), (3, 4)]


def slow_highlights(text, leaves):
    spans = T.spans(text)
    own = [T.normalize(text[a:b]) for a, b in spans]
    found = []
    for leaf in leaves:
        want = T.query_tokens(leaf.text)
        for i in range(len(own) - len(want) + 1):
            last = own[i + len(want) - 1]
            if own[i : i + len(want) - 1] == want[:-1] and (last == want[-1] or isinstance(leaf, Q.Term) and len(want[-1]) >= 3 and last.startswith(want[-1])):
                found.append((spans[i][0], spans[i + len(want) - 1][1]))
    return X.first_of_overlapping(sorted(found, key=lambda s: (s[0], -s[1])))


@pytest.mark.parametrize("query", ["tot", '"of the" OR total', "été", "of-the", "zzz"])
def test_highlights_equal_a_plain_search(query):
    leaves = Q.leaves(Q.parse(query))
    assert X.highlights(TEXT * 3, leaves) == slow_highlights(TEXT * 3, leaves)


def test_words_of_all_scripts():
    assert [T.spans(t) for t in ("東京x", "éa b", "a_b", "x" * 65, "9é")] == [[(0, 1), (1, 2), (2, 3)], [(0, 3), (4, 5)], [(0, 1), (2, 3)], [], [(0, 2)]]


@pytest.mark.parametrize(
    "pattern, text, hit",
    [
        (r"^[\w]+$", "été", True), (r"\bété\b", "un été.", True), (r"\bété\b", "unété.", False), (r"a\sb", "a b", True), (r"[^\W\d_]+x", "éx", True), (r"^[^\W\d_]$", "5", False),
        (r"[\W]", "a", False), (r"[\Wb]", "b", True), (r"x[\s]y", "x y", True), (r"[[:alpha:]]q", "aq", True), (r"[]a]b", "]b", True), (r"\d{2}", "٣٤", True), (r"\bfoo|bar\b", "xbar", True),
        (r"\[\w\]", "[é]", True), (r"\b(?:é|è)t\b", " ét ", True), (r"\b(?:é|è)t\b", "aét ", False), (r"[^\s]", " ", False), (r"\D", "٣", False),
    ],
)
def test_classes_count_for_all_scripts(spark, pattern, text, hit):
    import pyarrow as pa
    import pyarrow.compute as pc

    assert pc.match_substring_regex(pa.array([text]), compiled(pattern))[0].as_py() == hit


def test_a_word_being_typed_is_ranked(spark):
    rows = [(1, "/n/a.txt", "invoice paid"), (2, "/n/b.txt", "invoices invoiced"), (3, "/n/invoic.txt", "x"), (4, "/n/d.txt", "invoic"), (5, "/n/e.txt", "other")]
    docs = with_paths(spark.createDataFrame(rows, "doc_id long, path string, content string")).selectExpr("*", "'' as meta", "1L as size", "1L as mtime", "'text' as kind")
    index = I.Index(docs, I.postings(docs))
    got = I.ranked(index, "invoic").collect()
    assert [r.doc_id for r in got] == [3, 4, 1, 2] and all(r.score > 0 for r in got)
    assert [r.doc_id for r in I.ranked(index, "invoic", whole_word=True).collect()] == [3, 4]
    assert {r.doc_id for r in I.ranked(index, "invoic -paid").collect()} == {2, 3, 4} == {r.doc_id for r in index.matches("invoic -paid").collect()}
    assert [r.score for r in I.ranked(index, "-invoic").collect()] == [0.0]


def test_kinds_of_code():
    assert {kind_of(e) for e in "cxx hh sass ipynb tf sol patch rs py".split()} == {"code"} and kind_of("ai") == "pdf" and kind_of("sql") == "data" and kind_of("nope") == "other"
