"""Each registered query has a function, and the SQL names no query that isn't there."""

import __spark_entry__


def test_queries_and_their_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    plain = [q for q in queries if not (q.startswith("op") and q[2:3].isdigit()) and q != "pipeline"]
    assert set(plain) - set(sql) <= {"workflow_replay", "credit_with_acks"}
