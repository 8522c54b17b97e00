import random
from collections import Counter

from parchmill.llm import frequency
from tests.conftest import rows


def brute(lists, rare=2):
    occ, rec = Counter(), Counter()
    for l in lists:
        t = [x for x in l or [] if x is not None]
        occ.update(t)
        rec.update(set(t))
    n = len(lists)
    return sorted(((t, occ[t], rec[t], "rare" if rec[t] <= rare else "common" if rec[t] * 100 > 8 * n else None) for t in occ), key=repr)


def check(spark, lists):
    df = spark.createDataFrame([(l, "x", 1) for l in lists], "terms ARRAY<STRING>, term STRING, records INT").repartition(3)
    assert rows(frequency.frequencies(df).select("term", "occurrences", "records", "mark")) == brute(lists)


def test_equals_counter(spark):
    g = random.Random(2)
    check(spark, [[f"w{int(g.paretovariate(0.7))}" for _ in range(g.randrange(12))] for _ in range(500)])


def test_hot_term_nulls_and_empty(spark):
    check(spark, [["a", "a", None, "b"], None, [], [None], ["é" * 100_000, "a"], [""]] + [["hot"] * 50] * 200)
    check(spark, [])
    check(spark, [None])
    check(spark, [["one"]])


def test_more_heavy_terms_than_kept(spark, monkeypatch):
    monkeypatch.setattr(frequency, "HEAVY", 3)
    check(spark, [[f"w{i % 10}" for i in range(k % 23)] for k in range(200)])
