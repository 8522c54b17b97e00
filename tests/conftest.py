import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain(value):
    """Values of either engine in one form."""
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value


def against_sql(spark, query, sql, sf="sf0.001"):
    """Rows of a query that differ from its SQL, both ways."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(DATA, sf).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = query(spark, f"{DATA}/{sf}")
    names = sorted(df.columns)
    found = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    got = con.execute(sql)
    place = [d[0] for d in got.description]
    assert sorted(place) == names
    want = sorted(repr(tuple(plain(r[place.index(n)]) for n in names)) for r in got.fetchall())
    return [x for x in found if x not in set(want)][:3], [x for x in want if x not in set(found)][:3], len(found) - len(want)
