"""The driver's contract."""

import __spark_entry__ as entry


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and {"p1_found", "p3_found", "score_verdict"} <= set(q)
    assert entry.entry(spark).columns == ["report_id", "score", "verdict"]
