"""Every query of the core beside its SQL, over the smallest of the given tables, where these are."""

import os
from pathlib import Path

import pytest

from siftwright.plans import evidence, general

DATA = Path(os.environ.get("SIFTWRIGHT_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no tables")


def rows_of(frame) -> list[str]:
    columns = sorted(frame.columns)

    def plain(v):
        if v is None or v != v:
            return None
        return float(v) if isinstance(v, float) else v if isinstance(v, int | bool) else str(v)

    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted({**evidence.SQL, **general.SQL}))
def test_same_as_sql(spark, tables, name):
    got = {**evidence.QUERIES, **general.QUERIES}[name](spark, str(DATA)).toPandas()
    want = tables.execute({**evidence.SQL, **general.SQL}[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
