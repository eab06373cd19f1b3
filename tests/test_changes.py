import random
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon.operators.store import Store
from quillon.streaming import changes as C
from quillon.streaming import source as S
from quillon.streaming.source import NAME, files_of, register

SCHEMA = "path string, op string, from_path string, size long, mtime long, ts timestamp, seq long"
FILES = "path string, kind string, size long, mtime long"


def batch(spark, rows):
    """(path, op, from_path, size) in order; several share a ts, so that seq decides."""
    return spark.createDataFrame([(p, op, f, s, s, k // 3, k) for k, (p, op, f, s) in enumerate(rows)], SCHEMA.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts")).repartition(3)


def run(spark, files, rows):
    return sorted(map(tuple, C.apply_changes(spark.createDataFrame(files, FILES), batch(spark, rows)).collect()))


def test_a_chain_ends_at_its_last_name(spark):
    files = [("/a", "x", 7, 1), ("/z", "y", 9, 1)]
    assert run(spark, files, [("/b", "rename", "/a", None), ("/c", "rename", "/b", None)]) == [("/c", "x", 7, 1), ("/z", "y", 9, 1)]
    assert run(spark, files, [("/b", "rename", "/a", None), ("/a", "upsert", None, 5), ("/c", "rename", "/b", 8)]) == [("/a", None, 5, 5), ("/c", "x", 8, 8), ("/z", "y", 9, 1)]
    swapped = [("/t", "rename", "/a", None), ("/a", "rename", "/z", None), ("/z", "rename", "/t", None)]
    assert run(spark, files, swapped) == [("/a", "y", 9, 1), ("/z", "x", 7, 1)]
    assert run(spark, files, [("/b", "rename", "/a", None), ("/b", "remove", None, None)]) == [("/z", "y", 9, 1)]
    assert run(spark, files, [("/a", "rename", "/a", None)]) == files


def test_long_chains_take_few_rounds(spark):
    files = [("/0", "x", 7, 1)]
    chain = [(f"/{k + 1}", "rename", f"/{k}", None) for k in range(40)]
    assert run(spark, files, chain) == [("/40", "x", 7, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_one_change_after_the_other(spark, seed):
    rng = random.Random(seed)
    names = [f"/{i}" for i in range(25)]
    files = [(p, f"k{p}", i, i) for i, p in enumerate(names[:15])]
    now = {p: (kind, s, m) for p, kind, s, m in files}
    rows = []
    for k in range(150):
        op, p = rng.choice(["upsert", "remove", "rename", "rename"]), rng.choice(names)
        if op == "upsert":
            now[p] = (None, 100 + k, 100 + k)
            rows.append((p, op, None, 100 + k))
        elif op == "remove":
            now.pop(p, None)
            rows.append((p, op, None, None))
        elif now:
            f = rng.choice(sorted(now))
            if f != p:
                kind, s, m = now.pop(f)
                size = rng.choice([None, 500 + k])
                now[p] = (kind, s, m) if size is None else (kind, size, size)
                rows.append((p, op, f, size))
    assert run(spark, files, rows) == sorted((p, *v) for p, v in now.items())


def test_a_replayed_rename_moves_nothing(spark):
    files = [("/a", "x", 7, 1)]
    rows = [("/b", "rename", "/a", None)]
    once = run(spark, files, rows)
    assert run(spark, once, rows) == once == [("/b", "x", 7, 1)]


def test_steps_compose(spark, tmp_path):
    rows = [(1, "/old", "rename_from", 10, None, "c", None), (1, "/new", "rename_to", 11, 70, "c", 3), (1, "/x", "upsert", 10, 5, None, 1), (1, "/x", "upsert", 10, 6, None, 2), (1, "/gone", "remove", 12, None, None, None)]
    df = spark.createDataFrame(rows, "root long, path string, op string, t long, size long, cookie string, mtime long").selectExpr("root", "path", "op", "timestamp_seconds(t) as ts", "size", "cookie", "mtime")
    df.write.parquet(f"{tmp_path}/in")
    calm = C.debounce(spark.read.parquet(f"{tmp_path}/in"), "2 seconds")
    assert {(r.path, r.op, r.n, r.size, r.mtime) for r in calm.collect()} == {("/old", "rename_from", 1, None, None), ("/new", "rename_to", 1, 70, 3), ("/x", "upsert", 2, 6, 2), ("/gone", "remove", 1, None, None)}
    calm.select("root", "path", "op", "ts", "size", "mtime", "cookie", "seq").write.parquet(f"{tmp_path}/calm")
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit(files=spark.createDataFrame([("/old", "k", 70, 3), ("/gone", "k", 1, 1)], FILES))
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/calm").schema).parquet(f"{tmp_path}/calm")
    q = C.pair_renames(stream).writeStream.foreachBatch(C.into_store(store)).option("checkpointLocation", f"{tmp_path}/cp").start()
    began = time.time()
    while store.manifest()["generation"] < 2 and time.time() < began + 60:  # deadlines keep the query busy without an end
        time.sleep(0.5)
    q.stop()
    assert sorted(map(tuple, store.table("files").collect())) == [("/new", "k", 70, 3), ("/x", None, 6, 2)]


def test_reconcile_repairs_what_was_lost(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    big = 1 << 20
    store.commit(files=spark.createDataFrame([("/r/a", "k", big, 1), ("/r/b", "k", 2, 2), ("/s/c", "k", 3, 3), ("/r/d", "k", 4, 4)], FILES))
    listing = spark.createDataFrame([("/r/moved", big, 1), ("/r/d", 5, 9), ("/r/new", 6, 6)], "path string, size long, mtime long")
    failed = spark.createDataFrame([("/s",)], "dir string")
    assert C.reconcile(store, listing, failed) == 2
    assert sorted(map(tuple, store.table("files").collect())) == [("/r/d", None, 5, 9), ("/r/moved", "k", big, 1), ("/r/new", None, 6, 6), ("/s/c", "k", 3, 3)]
    assert C.reconcile(store, listing, failed) == 2


def write(folder, name, first, n):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table({"k": list(range(first, first + n))}), folder / name, row_group_size=7)


def test_source_goes_on_after_a_restart_in_bounded_batches(spark, tmp_path):
    register(spark)
    table, seen = tmp_path / "table", []
    write(table, "part-0", 0, 25)
    write(table, "part-1", 25, 3)

    def start(**options):
        stream = spark.readStream.format(NAME).schema("k long").option("path", str(table)).option("state", str(tmp_path / "state")).option("partitionRows", 4)
        for name, value in options.items():
            stream = stream.option(name, value)
        return stream.load().writeStream.foreachBatch(lambda df, n: seen.append(sorted(r.k for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp"))

    q = start(rowsPerBatch=10).trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    q.stop()
    assert [len(x) for x in seen if x] == [10, 10, 8] and sum(seen, []) == list(range(28))
    write(table, "part-2", 28, 12)
    q = start().trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sum(seen, []) == list(range(40)) and len([x for x in seen if x]) == 4
    assert len(files_of(str(table))) == 3
    assert spark.read.format(NAME).option("path", str(table)).load().count() == 40
    with pytest.raises(Exception, match="state"):
        spark.readStream.format(NAME).schema("k long").option("path", str(table)).option("rowsPerBatch", 1).load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp2")).start().processAllAvailable()


def test_store_refuses_a_second_writer(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit(t=spark.range(1))
    late = store.manifest()
    store.commit(t=spark.range(2))
    store.manifest = lambda: late
    with pytest.raises(RuntimeError):
        store.commit(t=spark.range(3))


CHANGES = "root long, path string, op string, from_path string, size long, mtime long, ts timestamp, seq long"


def burst(spark, n=40):
    """Files that are written, moved on and removed, in the order of time."""
    ops = [(0, f"/f{k % 7}", "rename" if k % 5 == 4 else "remove" if k % 11 == 10 else "upsert", f"/f{(k + 3) % 7}" if k % 5 == 4 else None, k, k, k) for k in range(n)]
    return spark.createDataFrame(ops, "root long, path string, op string, from_path string, size long, mtime long, seq long").selectExpr("root", "path", "op", "from_path", "size", "mtime", "timestamp_seconds(seq) as ts", "seq")


def held(store):
    return sorted(tuple(r) for r in store.table("files").select("path", "size", "mtime").collect())


def test_a_burst_is_committed_by_policy_and_nothing_is_lost(spark, tmp_path):
    register(spark)
    burst(spark).coalesce(1).write.option("parquet.block.size", 256).parquet(f"file://{tmp_path}/table")
    one, many = (Store(spark, f"file://{tmp_path}/{k}") for k in ("one", "many"))
    C.into_store(one)(burst(spark), 0)
    sizes = []

    def start(waiting):
        stream = spark.readStream.format(NAME).option("path", f"{tmp_path}/table").option("state", f"{tmp_path}/state").option("rowsPerBatch", 6).schema(CHANGES).load()

        def run(batch, number):
            sizes.append(batch.count())
            waiting(batch, number)

        return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/cp").start()

    waiting = C.Gathering(many, f"file://{tmp_path}/waiting", C.Policy(rows=15, seconds=3600))
    q = start(waiting)
    q.processAllAvailable()
    q.stop()
    assert sum(sizes) == 40 and max(sizes) <= 6
    assert many.manifest()["generation"] == 2 and len(waiting.waiting()) == 1  # 18 rows each; 4 wait
    again = C.Gathering(many, f"file://{tmp_path}/waiting")  # after a restart
    assert again.waiting() == waiting.waiting() and again.finish() == 1 and again.finish() == 0
    assert held(many) == held(one) and many.manifest()["generation"] == 3
    again(burst(spark), many.manifest()["batch"])  # a replay of what the store has seen
    assert again.waiting() == [] and held(many) == held(one)


def test_policy_of_bytes_and_age(spark, tmp_path):
    for k, policy in enumerate((C.Policy(bytes=1), C.Policy(seconds=0), C.Policy())):
        store = Store(spark, f"file://{tmp_path}/{k}")
        waiting = C.Gathering(store, f"file://{tmp_path}/w{k}", policy)
        waiting(burst(spark, 3), 0)
        assert waiting.waiting() == ([0] if k == 2 else [])
        waiting(burst(spark, 3).limit(0), 1)
        assert waiting.finish() == (2 if k == 2 else 0) and store.manifest()["batch"] == 1


def test_batches_of_bounded_bytes(tmp_path):
    import pyarrow as pa

    (tmp_path / "t").mkdir()
    pq.write_table(pa.table({"k": list(range(1000)), "s": [f"{i:060d}" for i in range(1000)]}), tmp_path / "t/a.parquet", row_group_size=100, compression="none", use_dictionary=False)
    size = sum(n * each for n, each in S.groups_in(str(tmp_path / "t"), str(tmp_path / "t/a.parquet"), 0))
    r = S.ChangeReader({"path": str(tmp_path / "t"), "state": str(tmp_path / "s"), "bytesPerBatch": str(int(size / 4))}, pa.schema([("k", pa.int64())]))
    at, rows = r.initialOffset(), []
    while (end := r.latestOffset()) != at:
        rows.append(sum(p.end - p.start for p in r.partitions(at, end)))
        at = end
    assert sum(rows) == 1000 and len(rows) <= 6 and max(rows) <= 251
    r.bytes = 1.0  # less than a row: one row each
    r.at = (0, 0)
    assert r.latestOffset() == {"file": 0, "row": 1}
