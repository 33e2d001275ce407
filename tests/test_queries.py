"""Every registered query of the core library runs, and equals its SQL where it has one."""

from qaloom.plans import load


def test_queries_equal_their_sql(spark, sf):
    import oracle_check

    assert oracle_check.compare(spark, list(load()[0]), sf) == []


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["model", "accuracy", "n"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
