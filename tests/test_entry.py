import __spark_entry__


def test_every_query_has_a_name_and_sql_belongs_to_a_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 50 and set(sql) <= set(queries)
    assert all(callable(q) for q in queries.values())
