import __spark_entry__ as E


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_flagship_has_a_stable_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "score"] and df.count() == 10
