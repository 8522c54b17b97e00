"""Cross-split overlaps and set joins against brute force over all pairs."""

import random
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmill.llm import overlap, setjoin
from tests.conftest import rows


def terms(tokens):
    return {t.strip(" \t").lower() for t in tokens or [] if t is not None and t.strip(" \t")}


def lines(seed, n=160):
    g = random.Random(seed)
    hot = ["los", "pag", "paiky"]
    base = [[g.choice(hot) if g.random() < 0.3 else f"w{g.randrange(400)}" for _ in range(g.randrange(7, 16))] for _ in range(n)]
    out = []
    for i, b in enumerate(base):
        out.append(b)
        if i % 3 == 0:
            c = b[:]
            for _ in range(g.randrange(4)):
                c[g.randrange(len(c))] = f"x{g.randrange(99)}"
            g.shuffle(c)
            out.append([t.upper() + " " if g.random() < 0.2 else t for t in c] + g.choice([[], [None], [" "], ["new"]]))
    return out


def test_overlaps_equal_all_pairs(spark):
    tokens = lines(3) + [["copy"] + [f"k{i}" for i in range(9)]] * 12 + [None, [], ["a"] * 20, [f"t{i}" for i in range(2000)], [f"t{i}" for i in range(2000)] + ["z"]]
    side = [None if i % 17 == 0 else i % 3 != 0 for i in range(len(tokens))]
    data = [(i, t, s, "src", "fp", 1) for i, (t, s) in enumerate(zip(tokens, side))]
    df = spark.createDataFrame(data + data[:20] + [(None, tokens[0], True, "s", "f", 1)], "id LONG, tokens ARRAY<STRING>, side BOOLEAN, source STRING, fp STRING, class INT")
    links, members = overlap.cross_split_overlaps(df, "id", "tokens", F.col("side"), {"source": F.col("source")})
    got = rows(overlap.expand(links, members, "id").select("left_key", "right_key"))
    sets = [terms(t) for t in tokens]
    want = [(a, b) for a in range(len(tokens)) for b in range(len(tokens)) if side[a] is True and side[b] is False and len(sets[a]) >= 8 <= len(sets[b]) and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    assert got == sorted(want, key=repr) and len(got) > 20
    links, members = overlap.cross_split_overlaps(df.limit(0), "id", "tokens", F.col("side"))
    assert links.count() == 0 and members.count() == 0


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 10**6), min_size=6, max_size=40), st.data())
def test_similar_sequences_share_a_fingerprint(common, data):
    """Two sets of at least 8 terms with similarity 3/4 or more keep a fingerprint in common, whatever is heavy."""
    d = data.draw(st.integers(0, len(common) // 3))
    extra = data.draw(st.sets(st.integers(10**6 + 1, 2 * 10**6), min_size=d, max_size=d))
    cut = data.draw(st.integers(0, d))
    extra = sorted(extra)
    a, b = common | set(extra[:cut]), common | set(extra[cut:])
    if min(len(a), len(b)) < 8:
        return
    heavy = np.array(data.draw(st.lists(st.sampled_from(sorted(common)), max_size=10)), np.int64)
    import pyarrow as pa

    keep = overlap._winnower(heavy)
    order = lambda s: sorted(s, key=lambda x: (x * 2654435761) % 2**32)
    batch = pa.RecordBatch.from_pydict({"class": [1, 2], "n": [len(a), len(b)], "left": [True, False], "right": [False, True], "hashes": [order(a), order(b)]}, schema=pa.schema([("class", pa.int64()), ("n", pa.int32()), ("left", pa.bool_()), ("right", pa.bool_()), ("hashes", pa.list_(pa.int64()))]))
    out = pa.Table.from_batches(list(keep(iter([batch])))).to_pylist()
    one, two = ({r["fp"] for r in out if r["class"] == c} for c in (1, 2))
    assert one & two


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60), max_size=40), st.sets(st.integers(0, 60), max_size=40))
def test_chain_and_extension_cover_what_is_shared(a, b):
    a, b = sorted(a), sorted(b)
    seeds = [(i, j) for i in range(len(a) - 1) for j in range(len(b) - 1) if a[i : i + 2] == b[j : j + 2]]
    chained = overlap.chain(seeds[::-1])
    assert all(x < u and y < v for (x, y), (u, v) in zip(chained, chained[1:])) and len(chained) == len(seeds)
    shared, stretches = overlap.extended(a, b, chained)
    assert shared == len(set(a) & set(b)) and (stretches > 0) == (shared > 0)
    assert overlap.extended(a, b, chained[::2])[0] == shared


def test_chain_is_a_longest_rising_one():
    assert len(overlap.chain([(0, 5), (1, 0), (2, 1), (3, 9), (4, 2), (4, 3)])) == 3
    assert overlap.chain([]) == []


def test_set_join_equals_all_pairs(spark):
    g = random.Random(5)
    pages = [[f"w{int(g.paretovariate(0.6)) % 3000}" for _ in range(g.randrange(1, 60))] for _ in range(150)]
    pages += [[t for t in p if g.random() < 0.8] + [f"n{g.randrange(9)}"] for p in pages[:60]] + [["a"], ["a"], ["A "], ["a", "b"], None, [], [None, " "], pages[0], pages[0][::-1]]
    data = [(i, p, 1, "x") for i, p in enumerate(pages)]
    df = spark.createDataFrame(data + data[5:9] + [(None, pages[0], 1, "x")], "id LONG, tokens ARRAY<STRING>, n INT, codes STRING")
    sets = [terms(p) for p in pages]
    for t in (Fraction(1, 2), Fraction(4, 5), Fraction(1, 3)):
        want = [(a, b) for a in range(len(pages)) for b in range(a + 1, len(pages)) if sets[a] and sets[b] and len(sets[a] & sets[b]) * t.denominator >= t.numerator * len(sets[a] | sets[b])]
        assert rows(setjoin.expand(*setjoin.similar_pairs(df, "id", "tokens", t), "id")) == sorted(want, key=repr)
    assert setjoin.expand(*setjoin.similar_pairs(df.limit(0), "id", "tokens"), "id").count() == 0
