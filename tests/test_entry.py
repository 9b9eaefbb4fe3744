"""The driver's contract."""

import __spark_entry__ as entry_point


def test_queries_and_oracles_are_listed_without_a_session():
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert len(queries) > 250 and set(oracles) <= set(queries)


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["day", "picks", "hits", "positives", "precision_at_3", "recall_at_3"] and df.count() > 0
