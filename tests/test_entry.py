import __spark_entry__ as entry


def test_entry_and_names(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0].found
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 50


def test_columns_of_queries(spark):
    for name in ("error_stats", "top_five", "projections"):
        assert len(set(entry.queries()[name](spark, entry.SMALL).columns)) > 1
