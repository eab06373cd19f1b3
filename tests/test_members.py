from pyspark.sql import functions as F

from quillon.functions import excerpt as X
from quillon.operators import files as O
from quillon.operators import members as M
from quillon.operators.store import Store
from quillon.streaming import changes as C


def test_member_docs(spark):
    rows = [("/m.pst/1", "/m.pst", "Inbox", "  Tides \n", "ann", "höher", 50, 9), ("/m.pst/2", "/m.pst", "", " \t", None, None, None, 9), ("/m.pst/2", "/m.pst", None, None, "", "", None, 9)]
    mail = spark.createDataFrame(rows, "path string, container string, folder string, subject string, sender string, text string, sent long, mtime long")
    got = M.member_docs(mail).collect()
    assert [(r.path, r.name, r.dir, r.shown_dir, r.size, r.mtime, r.meta, tuple(r.info)) for r in got] == [
        ("/m.pst/1", "Tides", "/m.pst/", "/m.pst › Inbox", 6, 50, "Tides\nann\nInbox", ("Tides", "ann", "Inbox")),
        ("/m.pst/2", "(no subject)", "/m.pst/", "/m.pst", None, 9, "(no subject)", ("(no subject)", None, None)),
        ("/m.pst/2", "(no subject)", "/m.pst/", "/m.pst", 0, 9, "(no subject)", ("(no subject)", None, None)),
    ]
    assert [tuple(r) for r in M.container_summary(mail).collect()] == [("/m.pst", 3, 2)]
    assert M.member_docs(mail.limit(0)).count() == M.container_summary(mail.limit(0)).count() == 0


def test_scan_requests_and_summary(spark):
    asked = spark.createDataFrame([(1, "/a"), (1, "/a"), (1, None), (2, "/a"), (2, "/b"), (2, "/a"), (3, None), (3, None)], "root long, dir string")
    assert sorted(O.scan_requests(asked).collect(), key=str) == sorted([(1, None), (2, "/a"), (2, "/b"), (3, None)], key=lambda r: f"Row(root={r[0]}, dir={r[1]!r})")
    listing = spark.createDataFrame([("/a/x", 5), ("/a/y", None), ("/a/b/x", 7)], "path string, size long")
    failed = spark.createDataFrame([("/z",), ("/z",)], "dir string")
    assert [tuple(r) for r in O.scan_summary(listing, failed).collect()] == [(2, 3, 12, 1)]
    assert [tuple(r) for r in O.scan_summary(listing.limit(0), failed.limit(0)).collect()] == [(0, 0, 0, 0)]


def test_classify(spark):
    now = spark.createDataFrame([("/f", "file"), ("/d", "dir"), ("/dev", None)], "path string, kind string")
    changed = spark.createDataFrame([(1, "/f"), (1, "/f"), (1, "/d"), (1, "/dev"), (2, "/lost")], "root long, path string")
    assert sorted(map(tuple, C.classify(changed, now).collect())) == [(1, "/d", "scan_dir"), (1, "/f", "upsert"), (2, "/lost", "remove")]


def test_head_ends_with_a_whole_character(spark):
    texts = ["", None, " \n\t", "abc", "a" * 239 + "é", "a" * 238 + "é", "a" * 237 + "😀", "x" + "😀" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.h for r in df.select("i", X.head(df.t).alias("h")).orderBy("i").collect()]
    assert got == [None, None, None, "abc", "a" * 239, "a" * 238 + "é", "a" * 237, "x" + "😀" * 59]


def test_paths_of_members(spark):
    cases = {
        "/m/a.pst/#7": ("/m/a.pst", 7), "/m/a.PST/#4294967295": ("/m/a.PST", 4294967295), "/m/a.pst/#4294967296": None, "/m/a.pst/#" + "9" * 40: None, "/m/a.zip/#7": None,
        "/m/a.pst/#": None, "/m/a.pst/7": None, "/m/a.pst": None, "/m\n/a.pst/#1": ("/m\n/a.pst", 1), "/m/a.pst/#1\n": None, "/m/x/a.pst/#1/b.pst/#02": ("/m/x/a.pst/#1/b.pst", 2), "": None, None: None,
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r.path: r.m and tuple(r.m) for r in df.select("path", M.split_member(F.col("path")).alias("m")).collect()}
    assert got == cases
    assert df.limit(1).select(M.member_path(F.lit("/a.pst"), F.lit(3)).alias("p")).first().p == "/a.pst/#3"


def test_members_are_replaced(spark):
    schema = "path string, size long"
    files = spark.createDataFrame([("/a.pst", 1), ("/a.pst/#1", 1), ("/a.pst/#2", 1), ("/b.pst/#1", 1), ("/c.pst/#1", 1), ("/a.pst.txt", 1)], schema)
    fresh = spark.createDataFrame([("/a.pst/#2", 5), ("/c.pst/#9", 5)], schema)
    read = spark.createDataFrame([("/a.pst",), ("/b.pst",), ("/a.pst",)], "path string")
    got = sorted(tuple(r) for r in M.replace_members(files, fresh, read).collect())
    assert got == [("/a.pst", 1), ("/a.pst.txt", 1), ("/a.pst/#2", 5), ("/c.pst/#1", 1)]


def test_a_recheck_happens_once(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    assert not s.recheck_once("mail", F.lit(True))
    s.commit(files=spark.createDataFrame([("/a.pst", 5), ("/b", 6), (None, 7)], "path string, mtime long"))
    assert s.recheck_once("mail", M.is_container(F.col("path"))) and not s.recheck_once("mail", F.lit(True))
    assert sorted(r.mtime for r in s.table("files").collect()) == [-1, 6, 7]
    assert s.recheck_once("other", F.col("path") == "/b") and s.manifest()["generation"] == 3 and not s.recheck_once("mail", F.lit(True))
    assert sorted(r.mtime for r in s.table("files").collect()) == [-1, -1, 7]
