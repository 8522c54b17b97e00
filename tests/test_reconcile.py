import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmill.operators import reconcile as R
from tests.conftest import rows

BELOW = st.integers(0, R.P - 1)


@given(st.lists(st.tuples(BELOW, BELOW), min_size=1, max_size=50))
def test_mulmod(pairs):
    a, b = (np.array(x, np.uint64) for x in zip(*pairs))
    assert R.mulmod(a, b).tolist() == [x * y % R.P for x, y in pairs]


@given(st.lists(st.tuples(st.integers(0, 4), BELOW), min_size=1, max_size=40))
def test_segment_product(pairs):
    ids, values = np.array([i for i, _ in pairs]), np.array([[v] for _, v in pairs], np.uint64)
    want = {}
    for i, v in pairs:
        want[i] = want.get(i, 1) * v % R.P
    at, prod = R.segment_product(ids, values)
    assert dict(zip(at.tolist(), prod[:, 0].tolist())) == want


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, (1 << 60) - 1), max_size=5), st.sets(st.integers(0, (1 << 60) - 1), max_size=5), st.sets(st.integers(0, (1 << 60) - 1), max_size=20))
def test_interpolation_recovers_the_difference(only_a, only_b, both):
    a, b = only_a | both, only_b | both
    only_a, only_b = a - b, b - a
    m = 11 + R.SPARE
    zs = [int(z) for z in R.points(m)]

    def chi(s, z):
        out = 1
        for h in s:
            out = out * (z - h) % R.P
        return out

    def at(coefs, z):
        return sum(int(c) * pow(z, i, R.P) for i, c in enumerate(coefs)) % R.P

    f = [chi(a, z) * pow(chi(b, z), R.P - 2, R.P) % R.P for z in zs]
    for p, q in R.rational(np.array([f, f], np.uint64), len(a) - len(b), R.lagrange(m - R.SPARE)):
        assert (len(p) - 1, len(q) - 1) == (len(only_a), len(only_b))
        assert all(at(p, h) == 0 for h in only_a) and all(at(q, h) == 0 for h in only_b)


def test_more_differences_than_points_are_not_solved():
    zs = [int(z) for z in R.points(6)]
    f = [1] * len(zs)
    for h in range(5):
        f = [x * (z - h) % R.P for x, z in zip(f, zs)]
    assert R.rational(np.array([f], np.uint64), 3, R.lagrange(4)) == [None]


SCHEMA = "k STRING, n INT, v STRING, w STRING, loaded TIMESTAMP, _k0 STRING, side INT, h LONG, difference STRING"


def _copy(spark, data):
    import datetime as dt

    return spark.createDataFrame([(k, n, v, w, t and dt.datetime(2030, 1, t), "x", 7, 1, "y") for k, n, v, w, t in data], SCHEMA)


def _differences(a, b, **kw):
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return rows(R.differences(a, b, {"k": F.lower(F.trim("k")), "n": F.col("n")}, {"v": blank("v"), "w": blank("w")}, F.col("loaded"), **kw))


def test_dirty_copies(spark):
    a = _copy(spark, [("A ", 1, "x", None, 1), ("a", 1, "old", None, None), ("b", 1, "x", "y", 1), ("b", 1, "x", "y", 1), ("c", 1, "x", "y", 1), (None, None, "n", "n", 1), (None, 2, "n", "n", 1), ("e", 1, "Z", "y", 2)])
    b = _copy(spark, [("a", 1, " x", "  ", 3), ("b", 1, "q", "r", 2), ("b", 1, "x", "y", 1), ("d", 1, "x", "y", 1), (None, None, "n", "m", 1), (None, 2, "n", "n", 1), ("e", 1, "z", "y", 2)])
    assert _differences(a, b) == sorted([("b", 1, "v"), ("b", 1, "w"), ("c", 1, "only_first"), ("d", 1, "only_second"), (None, None, "w"), ("e", 1, "v")], key=repr)


def test_empty_and_one_sided(spark):
    none, some = _copy(spark, []), _copy(spark, [("a", 1, "x", "y", 1), ("b", 2, "x", "y", 1)])
    assert _differences(none, none) == []
    assert _differences(some, some) == []
    assert _differences(some, none) == [("a", 1, "only_first"), ("b", 2, "only_first")]
    assert _differences(none, some) == [("a", 1, "only_second"), ("b", 2, "only_second")]


@pytest.mark.parametrize("bound", [1, 2, 16])
def test_many_differences_double_the_bound(spark, bound):
    a = _copy(spark, [(f"k{i}", i % 7, "x", "y" * (i % 3), 1) for i in range(600)])
    b = _copy(spark, [(f"k{i}", i % 7, "x" if i % 2 else "z", "y" * (i % 3), 1) for i in range(200, 800)])
    want = [(f"k{i}", i % 7, "only_first") for i in range(200)] + [(f"k{i}", i % 7, "only_second") for i in range(600, 800)] + [(f"k{i}", i % 7, "v") for i in range(200, 600) if not i % 2]
    assert _differences(a, b, degree_bound=bound) == sorted(want, key=repr)


def test_one_key_holds_most_rows(spark):
    a = _copy(spark, [("hot", 1, f"v{i}", "", 1 + i % 28) for i in range(3000)] + [("hot", 1, "last", "", 31)])
    b = _copy(spark, [("hot", 1, "last", "x" * 200_000, 1)])
    assert _differences(a, b) == [("hot", 1, "w")]
