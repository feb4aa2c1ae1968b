"""The text queries that SQL can follow, beside it, over the smallest of the given tables, where these are."""

import os
from pathlib import Path

import pytest

from siftwright.llm import queries

DATA = Path(os.environ.get("SIFTWRIGHT_DATA", "/root/testdata/sf0.001"))


@pytest.mark.skipif(not DATA.is_dir(), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = sorted(map(tuple, queries.QUERIES[name](spark, str(DATA)).toPandas().itertuples(index=False)))
    assert got == sorted(con.execute(queries.SQL[name]).fetchall())
