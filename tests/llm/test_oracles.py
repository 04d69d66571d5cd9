"""The queries that SQL can express, against it."""

import duckdb
import pytest
from helpers_llm import of

from tessella.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, small)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    flat = lambda rows: sorted(str(tuple(round(v, 8) if isinstance(v, float) else v for v in r)) for r in rows)
    assert flat(of(got, *names)) == flat(want[names].itertuples(index=False, name=None))
