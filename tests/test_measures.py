import time

import pytest
from pyspark.sql import functions as F

from quillon.operators.measures import Generations, Measures
from quillon.operators.store import Store
from quillon.streaming import changes as C


def test_stages_and_steps(spark):
    m = Measures()
    df = m.stage("all", spark.range(10).withColumn("n", F.when(F.col("id") != 3, F.col("id"))), "n")
    with m.step("run"), m.step("run"):
        assert m.stage("even", df.filter("id % 2 = 0")).count() == 5
    assert [tuple(r) for r in m.table(spark).collect()] == [("all", 10, 42), ("even", 5, 0)] and m.seconds["run"] > 0
    with pytest.raises(ValueError):
        m.stage("all", df)
    with pytest.raises(ZeroDivisionError), m.step("bad"):
        1 / 0
    assert "bad" in m.seconds
    m = Measures()
    m.stage("none", spark.range(0).withColumn("n", F.lit(1)), "n").collect()
    assert [tuple(r) for r in m.table(spark).collect()] == [("none", 0, 0)]


def test_listeners_of_a_store(spark, tmp_path):
    s, told = Store(spark, f"file://{tmp_path}/s"), []
    s.listeners += [lambda n, names: 1 / 0, lambda n, names: told.append((n, names))]
    with pytest.warns(UserWarning, match="generation 1"):
        s.commit(b=spark.range(1), a=spark.range(1))
    assert told == [(1, ["a", "b"])] and s.manifest()["generation"] == 1


def test_a_stream_tells_its_generations(spark, tmp_path):
    made = spark.range(4).selectExpr("id as root", "concat('/f', id) as path", "'upsert' as op", "cast(null as string) as from_path", "id as size", "id as mtime", "timestamp_seconds(id) as ts", "id as seq")
    made.write.parquet(f"file://{tmp_path}/t")
    store, told = Store(spark, f"file://{tmp_path}/s"), []
    listener = Generations(store, lambda *x: told.append(x), "told")
    spark.streams.addListener(listener)
    try:
        df = spark.readStream.schema(spark.read.parquet(f"file://{tmp_path}/t").schema).parquet(f"file://{tmp_path}/t")
        q = df.writeStream.queryName("told").foreachBatch(C.into_store(store)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        end = time.time() + 30
        while not told and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert (0, 4, 1) in told and store.table("files").count() == 4
