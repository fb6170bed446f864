"""Every registered query against its SQL on the smallest given tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as contract
from tickloom.checks.queries import registered

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")
SQL = contract.oracle_sql() if DATA.exists() else {}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(value):
        if isinstance(value, float):
            return None if math.isnan(value) else round(value, 6)
        return value

    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, str(DATA))
    want = duck.sql(SQL[name])
    assert canonical(got.columns, got.collect()) == canonical(want.columns, want.fetchall())


def test_every_sql_has_a_query_and_only_tree_fits_lack_sql():
    assert set(registered()) - set(contract.oracle_sql()) == {
        "gbt_eval", "importance", "ablation", "change_suite", "cross_suite", "price_vs_ofi_suite",
    }
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
