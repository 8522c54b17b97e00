"""Every query of the core against its SQL; those without SQL must run and give a stable schema."""

import importlib
from pathlib import Path

import pytest

from tests.conftest import DATA, against_sql

MODULES = [f"parchmill.plans.{m}" for m in ("copies", "tokens", "statistics", "alignment", "chance", "records", "models", "extras")]
QUERIES = {n: f for m in MODULES for n, f in importlib.import_module(m).QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in importlib.import_module(m).SQL.items()}
pytestmark = pytest.mark.skipif(not Path(DATA, "sf0.001").exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert against_sql(spark, QUERIES[name], SQL[name]) == ([], [], 0)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry_lists_every_core_query():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
