"""Every query of the engine against its SQL."""

import os

import duckdb
import pytest

from sieveline.plans import oracles, queries

SQL = {k: v for k, v in oracles.oracle_sql().items() if k != "scan_tree"}


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def test_all_have_sql():
    assert set(queries.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, duck, name):
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy()))
    assert rows(got) == rows(want)


def test_scan_tree(spark, sf_dir):
    import hashlib

    got = {(r["name"], r["size"], r["sha256"]) for r in queries.scan_tree(spark, sf_dir).collect()}
    assert got == {(f, os.path.getsize(p := f"{sf_dir}/{f}"), hashlib.sha256(open(p, "rb").read()).hexdigest()) for f in os.listdir(sf_dir)}


def test_plan_prunes_and_stays_native(spark, sf_dir):
    plan = queries.pdf_rules_normal(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "n_chars" not in plan and "lang" not in plan
