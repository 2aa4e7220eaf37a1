"""The operators' queries against their SQL, over the tables of the driver."""

import os

import duckdb
import pytest

from unitflow.llm.queries import QUERIES
from unitflow.llm.sql import ORACLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        if os.path.exists(path := f"{sf_dir}/{name}.parquet"):
            con.execute(f"create view {name} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert got and got == want
