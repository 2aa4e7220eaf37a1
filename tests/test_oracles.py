"""Every registered query against its SQL over the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from unitflow.plans.oracles import ORACLES
from unitflow.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def same_order(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def run_sql(duck, sql):
    cursor = duck.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    names, records = run_sql(duck, ORACLES[name])
    assert sorted(names) == sorted(df.columns)
    got = same_order(df.columns, df.collect())
    assert got, "a query without rows checks nothing"
    assert got == same_order(names, records)


def test_comparison_sees_a_changed_value(spark, duck, sf_dir):
    df = QUERIES["unit_counts"](spark, sf_dir)
    names, records = run_sql(duck, ORACLES["unit_counts"])
    at = names.index("n_units")
    records[0] = tuple(v + 1 if i == at else v for i, v in enumerate(records[0]))
    assert same_order(df.columns, df.collect()) != same_order(names, records)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["doc_id", "part", "n_pieces", "text"]
    assert df.count() > 0
