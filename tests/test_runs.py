"""Orchestration, reports and plug-ins."""

import pytest

from parchmill.functions import plugins
from parchmill.operators import runs
from parchmill.sources import files
from tests.conftest import rows


def test_variants(spark):
    protocol = {"a": 1, "b": [2]}
    assert runs.protocol_hash(protocol) == runs.protocol_hash({"b": [2], "a": 1})
    with pytest.raises(ValueError):
        runs.protocol_hash({"x": float("nan")})
    make = {"one": lambda: spark.range(3), "bad": lambda: spark.sql("SELECT no_such_column"), "two": lambda: spark.range(3).repartition(3)}
    r = runs.run_variants(spark, protocol, make)
    state = {x["variant"]: x for x in r.collect()}
    assert [state[v]["state"] for v in ("one", "bad", "two")] == ["done", "failed", "done"]
    assert state["one"]["digest"] == state["two"]["digest"] and state["one"]["rows"] == 3
    assert runs.run_variants(spark, protocol, make, done=r).count() == 3
    assert runs.compared(r, ["one", "two"]).count() == 2
    with pytest.raises(ValueError):
        runs.compared(r, ["one", "two", "bad"])
    assert {x["state"] for x in runs.run_variants(spark, protocol, make, budget=0.0).collect()} == {"skipped"}


def test_sealed_and_guarded(spark):
    called = []
    make = lambda: called.append(1) or spark.range(1)
    gates = spark.sql("SELECT 3 AS n, true AS a, false AS b")
    assert runs.sealed(gates, make) is None and not called
    assert runs.sealed(gates.drop("b"), make).count() == 1 and called
    report = spark.sql("SELECT 1 AS n, array(named_struct('token', 'x')) AS s")
    assert runs.guarded(report, {"n", "s"}, {"text"}) is report
    for allowed, forbidden in (({"n"}, set()), ({"n", "s"}, {"token"})):
        with pytest.raises(ValueError):
            runs.guarded(report, allowed, forbidden)


def test_reports(spark):
    df = spark.createDataFrame([("b|c", 1.5), ("a", None)], "k STRING, v DOUBLE")
    assert runs.markdown(df, "T").splitlines() == ["## T", "", "| k | v |", "|---|---|", "| a |  |", "| b\\|c | 1.5 |"]
    with pytest.raises(ValueError):
        runs.markdown(df, "T", most=1)
    assert runs.sidecar(b"", "x.json").endswith("  x.json\n")


def test_records(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "one.json").write_text('{"id": "1", "title": "x"}')
    (tmp_path / "a" / "more.json").write_text('[{"id": "2"}, {"id": "3", "title": "y"}]')
    assert rows(files.records(spark, str(tmp_path), "id STRING, title STRING").select("id", "title", "file")) == [("1", "x", "one.json"), ("2", None, "more.json"), ("3", "y", "more.json")]


def test_plugins(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "id INT, text STRING")
    assert rows(plugins.tokenized(df, "text", str.split).select("id", "pos", "token")) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "c")]
    plugins.register_tokenizer(spark, "spaced", lambda t: t.split())
    df.createOrReplaceTempView("some_lines")
    assert rows(spark.sql("SELECT id, t.pos, t.token FROM some_lines, LATERAL spaced(text) t")) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "c")]
    asked = plugins.decided(df, lambda i, t: t is not None and i > 1, "id", "text")
    assert rows(asked.select("id")) == [(3,)]
