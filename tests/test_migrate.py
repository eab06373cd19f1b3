import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import migrate as G
from quillon.operators.files import FLAGS
from quillon.operators.store import SCHEMA_VERSION, Store
from quillon.plans.engine import Engine, Request

FILES = "path string, size long, mtime long, flags long, status int"


def test_plan_of_each_kind(spark):
    cut, ocr = FLAGS["truncated"], FLAGS["ocr"]
    catalog = spark.createDataFrame(
        [("/a", 1, 1, 0, 0), ("/b", 2, 2, 0, 0), ("/c", 3, 3, cut, 0), ("/d", 4, 4, cut | ocr, 0), ("/e", 5, 5, 0, 1), ("/f", 6, 6, None, 4), ("/box", 7, 7, 0, 0), ("/g", 8, 8, 0, None), ("/a", 1, 1, 0, 0), (None, 1, 1, 0, 0)], FILES
    )
    texts = spark.createDataFrame([("/a", "one", False), ("/c", "three", False), ("/d", "four", True), ("/e", "five", False), ("/f", "six", None), ("/box", "x", False), ("/a", "one", False), (None, "n", False)], "path string, content string, cut boolean")
    old = spark.createDataFrame([(p, "old", 0, 0, "keep") for p in ("/a", "/b", "/c", "/d", "/e", "/f", "/box", "/g", "/lost", None)], "path string, content string, size int, mtime long, title string")
    planned = G.plan(old, catalog, texts, F.col("path").startswith("/box"))
    got = {r.path: (r.action, r.reason) for r in planned.collect()}
    assert got == {
        "/a": ("rebuild", "stored"), "/b": ("read", "not_stored"), "/c": ("read", "cut"), "/d": ("rebuild", "stored"), "/e": ("rebuild", "no_content"), "/f": ("rebuild", "stored"),
        "/box": ("read", "container"), "/g": ("rebuild", "no_content"),
    }
    assert planned.count() == 8
    docs = {r.path: (r.content, r.size, r.title) for r in G.rebuilt(old, planned, texts).collect()}
    assert docs == {"/a": ("one", 1, "keep"), "/d": ("four", 4, "keep"), "/e": (None, 5, "keep"), "/f": ("six", 6, "keep"), "/g": (None, 8, "keep")}
    assert G.rebuilt(old, planned, texts).columns == old.columns
    times = {r.path: r.mtime for r in G.to_read(catalog, planned).collect()}
    assert {p for p, t in times.items() if t == -1} == {"/b", "/c", "/box"}
    assert G.plan(old.limit(0), catalog, texts).count() == 0 and G.plan(old, catalog.limit(0), texts).count() == 0


def as_version(path, version):
    """Makes the manifests of a store those of another version."""
    for m in path.glob("manifest-*.json"):
        m.write_text(json.dumps(json.loads(m.read_text()) | {"version": version}))
        (path / f".{m.name}.crc").unlink(missing_ok=True)


def test_a_store_of_version_1_is_read_and_becomes_one_of_this(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.commit(documents=spark.createDataFrame([("/a", "x")], "path string, content string"), other=spark.range(3))
    s.commit(keep={"other": 1}, other=spark.range(2))
    as_version(tmp_path / "s", 1)
    docs = s.table("documents")
    assert s.manifest()["generation"] == 2 and docs.first().flags == 0 and "flags" not in spark.read.parquet(*s.segments("documents")).columns
    assert s.commit(keep={"other": 2}, other=spark.range(1)) == 3
    assert s.manifest()["version"] == SCHEMA_VERSION and "flags" in spark.read.parquet(*s.segments("documents")).columns
    assert s.table("other").count() == 6 and len(s.segments("other")) == 2
    as_version(tmp_path / "s", SCHEMA_VERSION + 1)
    with pytest.raises(RuntimeError, match="version"):
        s.table("documents")


def test_an_engine_takes_over_an_old_store(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    (root / "one.txt").write_text("tern over the quay")
    (root / "two.txt").write_text("petrel")
    e = Engine(spark, f"file://{tmp_path}/s")
    e.add_root(f"file:{root}")
    e.rescan()
    assert e.upgrade() == {}
    as_version(tmp_path / "s", 1)
    told = []
    assert e.upgrade(told.append) == {"rebuilt": 2, "read": 0} == told[0]
    assert e.store.manifest()["version"] == SCHEMA_VERSION
    assert [r.name for r in e.search(Request("tern")).items] == ["one.txt"] and e.rescan() == {"same": 2}
