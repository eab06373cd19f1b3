import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon.plans import texts as X
from quillon.plans.contents import path_hash


def scanned(df) -> int:
    """Rows that the scan of a plan gave on."""
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("texts")
    docs = spark.range(20_000).select(F.concat(F.lit("/t/"), F.col("id").cast("string")).alias("path"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 6).alias("content"))
    X.write(docs, f"file://{at}/x", group_bytes=64 << 10)
    return at / "x"


def test_a_page_reads_few_row_groups(spark, stored):
    groups = sum(pq.read_metadata(p).num_row_groups for p in stored.glob("*.parquet"))
    assert groups > 60
    paths = [f"/t/{i}" for i in range(0, 20_000, 5000)]
    df = X.lookup(spark, f"file://{stored}", [*paths, "/t/none"])
    assert sorted(r.path for r in df.select("path", "content").collect()) == sorted(paths)
    wide = X.lookup(spark, f"file://{stored}", [*paths, "/t/none"]).select("path", "content")
    wide._jdf.queryExecution().executedPlan().executeCollect()
    assert 0 < scanned(wide) < 20_000 / 8


def test_pages_of_both_sizes(spark, stored):
    page = spark.createDataFrame([(i, f"/t/{i}") for i in range(200)] + [(7, "/t/7"), (900, "/no"), (901, None)], "hit long, path string")
    one, two = (sorted(X.with_texts(page, f"file://{stored}", most).collect(), key=str) for most in (1000, 10))
    assert one == two and len(one) == 203
    by = {r.hit: r for r in one}
    assert by[900].content is None and by[901].cut is None and by[7].bytes == 384 and by[7].cut is False
    assert X.with_texts(page.limit(0), f"file://{stored}").count() == 0


def test_rows_of_odd_documents(spark):
    df = spark.createDataFrame([("/a", "äöü" * 5), ("/a", None), ("/b", None), (None, "x"), ("/c", "")], "path string, content string")
    got = {r.path: (r.content, r.bytes, r.cut) for r in X.rows(df, most=4).collect()}
    assert got == {"/a": ("äöüä", 30, True), "/b": ("", 0, False), "/c": ("", 0, False)}
    assert X.rows(df.limit(0)).count() == 0
    assert df.select(path_hash(F.lit("/ä b")).alias("h")).first().h == X.key_of("/ä b")
