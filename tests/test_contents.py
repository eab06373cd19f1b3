import hashlib

from pyspark.sql import functions as F

from quillon.plans import contents as K
from quillon.plans.corpus import with_paths

TEXTS = ["tern over the quay", "petrel", "tern over the quay", "", None, "petrel"]


def docs_of(spark, first, texts):
    rows = [(first + i, f"/n/f{first + i}.txt", t) for i, t in enumerate(texts)]
    return with_paths(spark.createDataFrame(rows, "doc_id long, path string, content string")).selectExpr("*", "'' as meta", "1L as size", "1L as mtime", "'text' as kind")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_copies_and_touched_files_add_no_postings(spark, tmp_path):
    c = K.Contents(spark, f"file://{tmp_path}/contents")
    one = docs_of(spark, 10, TEXTS)
    assert c.add(one) == 3
    posts = c.store.table("postings").count()
    assert posts == 5 and c.store.table("members").count() == 6
    two = docs_of(spark, 20, TEXTS)  # the same texts again
    assert c.add(two) == 0
    assert c.store.table("postings").count() == posts and c.store.table("members").count() == 12
    assert c.add(docs_of(spark, 30, ["petrel", "skua"])) == 1
    assert c.store.table("postings").count() == posts + 1
    docs = one.unionByName(two).unionByName(docs_of(spark, 30, ["petrel", "skua"]))
    index = c.index(docs)
    assert ids(index.matches("tern")) == [10, 12, 20, 22] and ids(index.matches("petrel OR skua")) == [11, 15, 21, 25, 30, 31]
    assert ids(index.matches('"over the" -f12')) == [10, 20, 22] and ids(index.matches("-tern -petrel")) == [13, 14, 23, 24, 31]


def test_hashes(spark):
    df = spark.createDataFrame([("é",), (None,)], "t string")
    assert [r.h for r in df.select(K.content_hash(F.col("t")).alias("h")).collect()] == [hashlib.sha256(x.encode()).hexdigest() for x in ("é", "")]
    assert df.select(K.path_hash(F.lit("/a")).alias("h")).first().h == int(hashlib.sha256(b"/a").hexdigest()[:15], 16)
