"""Every query on training text against its SQL, or against brute force in the other modules here."""

from pathlib import Path

import pytest

from parchmill.llm import queries as Q
from tests.conftest import DATA, against_sql

pytestmark = pytest.mark.skipif(not Path(DATA, "sf0.001").exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, name):
    assert against_sql(spark, Q.QUERIES[name], Q.SQL[name]) == ([], [], 0)


@pytest.mark.parametrize("name", sorted(n for n in set(Q.QUERIES) - set(Q.SQL) if not n.startswith("p9")))
def test_runs(spark, name):
    df = Q.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_nothing_else_imports_this_package():
    root = Path(__file__).resolve().parents[2]
    for p in [*root.glob("*.py"), *root.glob("parchmill/**/*.py"), *root.glob("tests/*.py")]:
        if "llm" not in p.relative_to(root).parts:
            assert not any("parchmill.llm" in l and l.lstrip().startswith(("import", "from")) for l in p.read_text().splitlines()), p
