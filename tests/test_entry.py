import __spark_entry__ as entry


def test_names_and_flagship(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == entry.entry(spark).columns and df.count() > 0
