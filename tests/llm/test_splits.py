import random

from pyspark.sql import functions as F

from parchmill.llm import splits
from tests.conftest import rows


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_equal_union_find(spark):
    g = random.Random(1)
    edges = [(f"n{g.randrange(150):03}", f"n{g.randrange(150):03}") for _ in range(120)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("hub", f"s{i}") for i in range(200)]
    df = spark.createDataFrame(edges + [(None, "x"), ("x", None), ("y", "y")] + edges[:5], "u STRING, v STRING")
    want = {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert dict(map(tuple, splits.components(df).collect())) == want
    assert splits.components(df.limit(0)).count() == 0


SCHEMA = "id LONG, a STRING, b STRING, split STRING, component STRING, node STRING"


def _groups(spark, data):
    df = spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)
    fold = lambda c: F.lower(F.trim(c))
    return splits.tied_groups(df, "id", {"a": fold("a"), "b": fold("b")}, {"split": fold("split")})


def test_broken_ties(spark):
    data = [(1, "F1", "p1", "train"), (2, " f1", "p2", "TRAIN "), (3, None, "P2", "test"), (4, "f9", None, "test"), (5, None, None, "train"), (6, None, None, "test"), (7, "f9", "p9", None), (8, "f1", None, None), (8, "f1", None, None), (None, "f9", None, "test")]
    g = _groups(spark, data)
    assert g.count() == 9
    assert rows(splits.broken_ties(g, "split").select("id")) == [(1,), (2,), (3,), (8,)]
    assert len({c for i, c in g.select("id", "component").collect() if i in (5, 6)}) == 2
    assert splits.broken_ties(_groups(spark, []), "split").count() == 0


def test_same_name_of_different_kinds_is_no_tie(spark):
    g = _groups(spark, [(1, "x", None, "train"), (2, None, "x", "test")])
    assert splits.broken_ties(g, "split").count() == 0


def test_assignment_keeps_components_and_shares(spark):
    data = [(i, f"f{i // 5}", None, None) for i in range(4000)]
    out = splits.assign(_groups(spark, data), {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert out.groupBy("component").agg(F.countDistinct("assigned").alias("n")).where("n > 1").count() == 0
    share = {r["assigned"]: r["count"] / 4000 for r in out.groupBy("assigned").count().collect()}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["validation"] - 0.1) < 0.02


def test_a_third_in_one_component(spark):
    data = [(i, "hot" if i < 1000 else f"f{i}", None, None) for i in range(3000)]
    out = splits.assign(_groups(spark, data), {"train": 0.8, "validation": 0.1, "test": 0.1}, apart=0.05)
    share = {r["assigned"]: r["count"] / 3000 for r in out.groupBy("assigned").count().collect()}
    assert abs(share["train"] - 0.8) < 0.03 and {r["assigned"] for r in out.where("id < 1000").select("assigned").distinct().collect()} == {"train"}
    by_hash = splits.assign(_groups(spark, data), {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert by_hash.count() == 3000 and by_hash.where("id < 1000").select("assigned").distinct().count() == 1
    assert splits.assign(_groups(spark, []), {"train": 1.0}).count() == 0
