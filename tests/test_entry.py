import __spark_entry__ as e


def test_every_oracle_belongs_to_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
