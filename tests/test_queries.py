"""Registered queries against their DuckDB twins, and the plans they get."""

import decimal

import duckdb
import pandas as pd
import pytest

from quadloom.engine import tables_engine
from quadloom.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float, decimal.Decimal)):
        return str(v)
    return str(round(float(v), 6) + 0.0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = sorted(tuple(plain(r[c]) or "" for c in sorted(df.columns)) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    cur = duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(plain(r[cols.index(c)]) or "" for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(cols) == sorted(df.columns)
    assert rows == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scan_a_star(spark):
    e = tables_engine(spark, DIR)
    p = plan(e.query("SELECT ?n ?b ?m { ?c t:c_name ?n ; t:c_acctbal ?b ; t:c_mktsegment ?m FILTER(?b > 100) }"))
    assert p.count("FileScan") == 1 and "Join" not in p
    assert "GreaterThan(c_acctbal,100.0)" in p and "c_nationkey" not in p.split("ReadSchema")[1]


def test_keys_are_joined_natively(spark):
    p = plan(tables_engine(spark, DIR).query("SELECT ?cn ?rn { ?c t:c_nation/t:n_region ?r . ?r t:r_name ?rn . ?c t:c_name ?cn }"))
    assert "Cartesian" not in p and "NestedLoop" not in p and "urn:tpch:nation/" not in p


def test_hash_subject_is_not_computed(spark):
    assert "sha1" not in plan(tables_engine(spark, DIR).query("SELECT (SUM(?q) AS ?s) { ?l t:l_quantity ?q ; t:l_returnflag 'R' }"))


def test_explain_and_entry(spark):
    import __spark_entry__

    assert "bgp" in tables_engine(spark, DIR).explain("SELECT * { ?r t:r_name ?n }")
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
