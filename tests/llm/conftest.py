import pytest

#: Texts that every operator must bear: null, empty, blank, one word, repeats, ties, other scripts, long ones.
TEXTS = [None, "", " \n\t ", "word", "A b c d e f g", "a B c d e f g", "ünï cödé 東京 \U0001f600 <|endoftext|> it's", "x" * 70_000, "no spaces " * 9000, "same text here and there " * 10, "same text here and there " * 10]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with null and repeated ids and with columns whose names clash with those that operators add."""
    rows = [(i, t, "n_tokens", 1.5, i) for i, t in enumerate(TEXTS)] + [(None, "a b c d e f g", None, None, None), (3, "word", "again", 0.0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score double, block long").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def sample(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df.cache()
