import time

from quillon.operators import files as O
from quillon.operators.store import Store
from quillon.streaming import changes as C


def test_diff_renames_and_guard(spark):
    old = spark.createDataFrame([("/a/x", 70000, 1), ("/a/y", 10, 1), ("/b/z", 5, 5), ("/c/big1", 99999, 7), ("/c/big2", 99999, 7)], "path string, size long, mtime long")
    new = spark.createDataFrame([("/a/moved", 70000, 1), ("/a/y", 11, 1), ("/d/n1", 99999, 7)], "path string, size long, mtime long")
    d = O.diff(new, old)
    assert {r.path: r.action for r in d.collect()} == {"/a/moved": "new", "/a/x": "deleted", "/a/y": "changed", "/b/z": "deleted", "/c/big1": "deleted", "/c/big2": "deleted", "/d/n1": "new"}
    assert sorted((r.from_path, r.to_path) for r in O.rename_pairs(d).collect()) == [("/a/x", "/a/moved"), ("/c/big1", "/d/n1")]
    failed = spark.createDataFrame([("/c/",), ("/bb",)], "dir string")
    assert sorted(r.path for r in O.guarded_deletes(d, failed).collect()) == ["/a/x", "/b/z"]


def test_store_flips_last_skips_replays_and_passes_damage(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.manifest()["generation"] == 0 and store.table("files") is None
    assert store.commit(files=spark.range(3)) == 1
    assert store.commit(batch=5, files=spark.range(4)) == 2
    assert store.commit(batch=5, files=spark.range(99)) == 2
    assert store.table("files").count() == 4
    (tmp_path / "store/manifest-3.json").write_text("{broken")
    assert store.manifest()["generation"] == 2


def test_apply_changes_is_idempotent(spark):
    files = spark.createDataFrame([("/a", 1, 1), ("/b", 2, 2), ("/c", 3, 3)], "path string, size long, mtime long")
    ch = spark.createDataFrame([("/d", "rename", "/a", None, None), ("/b", "remove", None, None, None), ("/e", "upsert", None, 9, 9)], "path string, op string, from_path string, size long, mtime long")
    once = C.apply_changes(files, ch)
    want = [("/c", 3, 3), ("/d", 1, 1), ("/e", 9, 9)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, C.apply_changes(once, ch).collect())) == want


def test_debounce_storm_and_supersede(spark):
    rows = [(1, "/a", "create", "2024-01-01 00:00:00.0"), (1, "/a", "modify", "2024-01-01 00:00:00.3"), (1, "/a", "remove", "2024-01-01 00:00:05"), (2, "/b", "modify", "2024-01-01 00:00:01")]
    ch = spark.createDataFrame(rows, "root long, path string, op string, ts string").withColumn("ts", __import__("pyspark").sql.functions.to_timestamp("ts"))
    assert sorted((r.path, r.op, r.n) for r in C.debounce(ch).collect()) == [("/a", "modify", 2), ("/a", "remove", 1), ("/b", "modify", 1)]
    storm = C.storms(ch, "1 minute", 0)
    assert sorted(r.root for r in storm.collect()) == [1, 2]
    assert sorted((r.root, r.op) for r in C.supersede(ch, C.storms(ch.filter("root = 1"), "1 minute", 0)).collect()) == [(1, "rescan"), (2, "modify")]


def test_stream_into_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit(files=spark.createDataFrame([("/a", 1, 1)], "path string, size long, mtime long"))
    schema = "path string, op string, from_path string, size long, mtime long"
    spark.createDataFrame([("/b", "upsert", None, 5, 5), ("/a", "remove", None, None, None)], schema).write.parquet(f"{tmp_path}/in")
    q = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(C.into_store(store)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in store.table("files").collect()] == [("/b", 5, 5)]


def test_stream_renames(spark, tmp_path):
    schema = "root long, path string, op string, ts timestamp, cookie string"
    df = spark.createDataFrame([(1, "/old", "rename_from", "2024-01-01", "c"), (1, "/new", "rename_to", "2024-01-02", "c"), (1, "/x", "modify", "2024-01-01", None)], "root long, path string, op string, ts string, cookie string")
    df.selectExpr("root", "path", "op", "cast(ts as timestamp) ts", "cookie").write.parquet(f"{tmp_path}/in")
    q = C.pair_renames(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("renames").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    began = time.time()
    while spark.table("renames").count() < 2 and time.time() < began + 120:  # deadlines keep the query busy without an end
        time.sleep(0.5)
    q.stop()
    assert sorted((r.op, r.path, r.from_path) for r in spark.table("renames").collect()) == [("modify", "/x", None), ("rename", "/new", "/old")]


def test_problems_flags_touch_recheck(spark):
    f = spark.createDataFrame([("/A/x.pdf", 2, 32, 5), ("/a/y.pst", 4, 2, 1), ("/b", 0, 0, 3)], "path string, status int, flags long, size long").selectExpr("*", "1L as mtime", "1 as root")
    assert [r.path for r in O.problems(f, contains="%a/").collect()] == ["/A/x.pdf", "/a/y.pst"]
    assert [r.path for r in O.pending_ocr(f).collect()] == ["/a/y.pst"]
    assert [r.n for r in f.select(O.flag_names(f.flags).alias("n")).collect()] == [["failed"], ["needs_ocr"], []]
    assert sorted(r.mtime for r in O.recheck(f, f.path.endswith(".pst")).collect()) == [-1, 1, 1]


def test_every_root_has_a_row(spark):
    roots = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/c")], "root int, path string")
    files = spark.createDataFrame([(1, 5, 9, 0), (1, None, 3, 2), (1, 7, 99, 6), (3, 4, None, 4), (8, 1, 1, 0)], "root int, size long, mtime long, status int")
    got = {r.root: tuple(r)[1:] for r in O.root_info(roots, files).collect()}
    assert got == {1: ("/a", 2, 5, 1, 9), 2: ("/b", 0, 0, 0, None), 3: ("/c", 1, 4, 1, None)}
    assert O.root_info(roots, files.limit(0)).agg({"files": "sum"}).first()[0] == 0


def test_percentiles(spark):
    rows = spark.createDataFrame([("a", float(k)) for k in range(1, 101)] + [("b", 7.0), ("b", 7.0), ("b", None), ("c", None)], "g string, v double")
    got = {r.g: r for r in O.percentiles(rows, "v", ("g",)).collect()}
    assert set(got) == {"a", "b"} and (got["a"].n, got["a"].mean, got["a"].p50, round(got["a"].p99, 6)) == (100, 50.5, 50.5, 99.01)
    assert (got["b"].n, got["b"].p50, got["b"].p95) == (2, 7.0, 7.0)
    assert O.percentiles(rows.limit(0), "v", ("g",)).count() == 0
