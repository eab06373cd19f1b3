from datetime import datetime, timezone

import pytest

from quillon.functions import query as Q
from quillon.functions.query import And, Field, Not, Or, Phrase, Term

NOW = datetime(2026, 9, 24, 12, tzinfo=timezone.utc)


def day(y, m, d):
    return int(datetime(y, m, d, tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    "text, tree",
    [
        ("a b", And((Term("a"), Term("b")))),
        ("a OR b c", Or((Term("a"), And((Term("b"), Term("c")))))),
        ("a | b || c", Or((Term("a"), Term("b"), Term("c")))),
        ("a|b", Term("a|b")),
        ("a && b AND c", And((Term("a"), Term("b"), Term("c")))),
        ("a -b", And((Term("a"), Not(Term("b"))))),
        ("a-b - c", And((Term("a-b"), Term("-"), Term("c")))),
        ("NOT a", Not(Term("a"))),
        ("not a or b", And((Term("not"), Term("a"), Term("or"), Term("b")))),
        ('"a b" c*', And((Phrase("a b"), Term("c", True)))),
        ('"open end', Phrase("open end")),
        ("(a OR b) (c", And((Or((Term("a"), Term("b"))), Term("c")))),
        ("a) b", And((Term("a"), Term("b")))),
        ("OR AND", None),
        ("", None),
        ("ext:.PDF,txt;*.md", Field("ext", ("pdf", "txt", "md"))),
        ("type:excel|txt", Field("kind", ("spreadsheet", "text"))),
        ("foo:bar", Term("foo:bar")),
        ('path:"a b"', Field("path", ("a b",))),
    ],
)
def test_trees(text, tree):
    assert Q.parse(text, NOW) == tree


@pytest.mark.parametrize("text", ["ext:", "type:nope", "modified:2024-13", "size:big", "x" * 9000, "(" * 65 + "a" + ")" * 65])
def test_errors(text):
    with pytest.raises(Q.QueryError):
        Q.parse(text, NOW)


@pytest.mark.parametrize(
    "value, bounds",
    [
        ("2024", (day(2024, 1, 1), day(2025, 1, 1))), ("2024-12", (day(2024, 12, 1), day(2025, 1, 1))), ("2024/02/29", (day(2024, 2, 29), day(2024, 3, 1))),
        (">2024-01", (day(2024, 2, 1), None)), (">=2024", (day(2024, 1, 1), None)), ("<2024", (None, day(2024, 1, 1))), ("<=2024", (None, day(2025, 1, 1))),
        ("2023..2024", (day(2023, 1, 1), day(2025, 1, 1))), ("..2024", (None, day(2025, 1, 1))), ("today", (day(2026, 9, 24), day(2026, 9, 25))),
        ("7d", (int(NOW.timestamp()) - 7 * 86400, None)), (">1y", (None, int(NOW.timestamp()) - 365 * 86400)),
    ],
)
def test_dates(value, bounds):
    assert Q.modified(value, NOW) == bounds


@pytest.mark.parametrize(
    "value, bounds",
    [("10kb", (10240, None)), (">1.5k", (1537, None)), ("<1m", (None, 1 << 20)), ("<=5", (None, 6)), ("=7", (7, 8)), ("1k..2k", (1024, 2049)), ("1tib", (1 << 40, None))],
)
def test_sizes(value, bounds):
    assert Q.size(value) == bounds


def test_split_filters():
    fields, rest = Q.split_filters('ext:pdf total  "was" foo:bar size:>1k', NOW)
    assert [f.name for f in fields] == ["ext", "size"] and rest == 'total  "was" foo:bar'
    assert Q.split_filters("a  b") == ([], "a  b")


def test_leaves_leave_out_what_is_negated():
    assert Q.leaves(Q.parse('a -b "c d" ext:txt')) == [Term("a"), Phrase("c d")]
