import __spark_entry__


def test_names_match():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r.has <= r.total for r in rows)
