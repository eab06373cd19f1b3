import pytest

from quillon.functions import query as Q
from quillon.plans import index as I
from quillon.plans import nodes as N
from quillon.plans import scan as S
from quillon.plans.corpus import with_paths

TEXTS = ["The tern over the quay", "over the tern", "the ternary", "tern", None, "", "THE TERN again"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"/n/tern{k}.txt", t) for k, t in enumerate(TEXTS)]
    return with_paths(spark.createDataFrame(rows, "doc_id long, path string, content string")).selectExpr("*", "'' as meta", "1L as size", "1L as mtime", "'text' as kind")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.mark.parametrize(
    ("text", "found"),
    [('begins:"the tern"', [0, 6]), ("BEGINS:the", [0, 2, 6]), ("-begins:the", [1, 3, 4, 5]), ("begins:the -begins:over again", [6]), ("begins:over OR (begins:the quay)", [0, 1]), ("begins:!!", []), ("begins:tern3", [3])],
)
def test_scan_and_index_agree(docs, text, found):
    index = I.Index(docs, I.postings(docs))
    assert ids(S.smart(docs, text)) == ids(index.matches(text)) == ids(index.scored(text)) == found


def test_scores_and_weight(docs):
    index = I.Index(docs, I.postings(docs))
    score = {r.doc_id: r.score for r in I.ranked(index, "begins:over OR quay", whole_word=True).collect()}
    single = {r.doc_id: r.score for r in I.ranked(index, "over AND quay", whole_word=True).collect()}
    assert set(score) == {0, 1} and all(score.values()) and set(single) == {0}
    light = type("Light", (N.Begins,), {"weight": 1.0})
    Q.register("light", light)
    a, b = (I.ranked(index, f"{n}:over").collect()[0].score for n in ("begins", "light"))
    assert a == pytest.approx(2 * b, abs=2e-6)


def test_names_of_nodes():
    for bad in ("size", "a b", ""):
        with pytest.raises(Q.QueryError):
            Q.register(bad, N.Begins)
    with pytest.raises(Q.QueryError):
        Q.parse("begins:")
    assert Q.leaves(Q.parse("begins:x tern")) == [Q.Term("tern")] and Q.parse("other:x") == Q.Term("other:x")
