import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from parchmill.llm import leakage
from parchmill.llm.words import words
from tests.conftest import rows


def contains(doc, item):
    d, i = words(doc or ""), words(item or "")
    n = min(12, len(i))
    runs = {tuple(i[s : s + n]) for s in range(len(i) - n + 1)} if i else set()
    return any(tuple(d[s : s + n]) in runs for s in range(len(d) - n + 1))


def test_words():
    assert words("The ﬁre­place—Ｘ２, fo‍ld re-\n  bound re-\r\nread x_y") == ["the", "fireplace", "x2", "fold", "rebound", "reread", "x", "y"]


@given(st.lists(st.integers(-1, 5), min_size=1, max_size=15), st.lists(st.integers(-1, 5), max_size=15))
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y and x >= 0 else max(t[i][j + 1], t[i + 1][j])
    assert leakage.lcs(np.array(a), np.array(b)) == t[-1][-1]


def test_passages_cover_every_run_of_twelve():
    for n in range(1, 70):
        starts, block = leakage._passages(np.arange(n, dtype=np.int32), 1)
        run = min(12, n)
        assert all(any(a <= s and s + run <= a + leakage.WIDTH for a in starts) for s in range(n - run + 1))
        assert set(block[block >= 0].tolist()) == set(range(n))


def test_sparse_algebra_equals_dense():
    g = np.random.default_rng(3)
    block, idf, x = g.integers(-1, 6, (40, 15)).astype(np.int32), g.random(6).astype(np.float32) + 1, g.random((6, 4)).astype(np.float32)
    dense = np.zeros((40, 6))
    for i, row in enumerate(block):
        for c in row[row >= 0]:
            dense[i, c] += idf[c]
    assert leakage._document_frequency(block, 6).tolist() == (dense > 0).sum(axis=0).tolist()
    unit = dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    for want, w in ((dense, leakage._weights(block, idf, False)), (unit, leakage._weights(block, idf, True))):
        assert np.allclose(leakage._project(block, w, x), want @ x, atol=1e-4)
        assert np.allclose(leakage._spread(block, w, leakage._project(block, w, x), 6), want.T @ (want @ x), atol=1e-3)


def test_windows_cover_every_run():
    for n in range(1, 80):
        for width, step in ((15, 4), (9, 4)):
            cuts = leakage._windows(n, width, step)
            run = width - step + 1
            assert all(any(a <= s and s + min(run, n) <= b for a, b in cuts) for s in range(max(1, n - run + 1)))


def test_verbatim_equals_brute_force(spark):
    g = random.Random(6)
    vocabulary = ["the", "of", "a", "in"] * 8 + [f"v{i}" for i in range(300)]
    make = lambda n: [g.choice(vocabulary) for _ in range(n)]
    items = [" ".join(make(g.choice([5, 8, 12, 20, 60]))) for _ in range(25)]
    docs = [" ".join(make(g.randrange(3, 120))) for _ in range(150)]
    for k in range(60):
        i = g.choice(items).split()
        s = g.randrange(max(1, len(i) - 11))
        d = make(g.randrange(40))
        at = g.randrange(len(d) + 1)
        docs.append(", ".join(d[:at] + i[s : s + g.choice([11, 12, 13, 99])] + d[at:]).upper())
    docs += [None, "", "...", " ".join(make(20_000) + items[0].split()), items[3]]
    df = spark.createDataFrame([(i, d, "x", 1) for i, d in enumerate(docs)], "doc LONG, text STRING, how STRING, share INT")
    it = spark.createDataFrame([(i, t, "y") for i, t in enumerate(items + [None, "", "!"])] + [(0, items[0], "y")], "item LONG, text STRING, codes STRING")
    out = leakage.leaks(df, "doc", "text", it, "item", "text")
    want = sorted(((d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if contains(doc, item)), key=repr)
    assert rows(out.where("how = 'verbatim'").select("doc", "item")) == want and len(want) > 40
    assert rows(leakage.leaks(df, "doc", "text", it, "item", "text", block=7, vocabulary=40).where("how = 'verbatim'").select("doc", "item")) == want
    assert leakage.leaks(df.limit(0), "doc", "text", it, "item", "text").count() == 0
    assert leakage.leaks(df, "doc", "text", it.limit(0), "item", "text").count() == 0


def test_paraphrase(spark):
    item = "the abbot of carmel sold the seventh ledger to a merchant from toledo in the winter of the great flood near the old harbour"
    near = "so the abbot of carmel had sold his seventh ledger to one merchant from toledo in that winter of a great flood near our old harbour"
    other = "the weather in the winter was cold and the harbour was closed to all ships for a month or two in that year"
    df = spark.createDataFrame([(1, near), (2, other), (3, item)] + [(i, "nothing of the kind is said in this text about the matter") for i in range(10, 40)], "doc LONG, text STRING")
    it = spark.createDataFrame([(7, item)], "item LONG, text STRING")
    assert rows(leakage.leaks(df, "doc", "text", it, "item", "text").select("doc", "how")) == [(1, "paraphrase"), (3, "verbatim")]


def test_sparse_paraphrase_whatever_the_other_items(spark):
    item = "the abbot of carmel sold seventh ledger to merchant from toledo in winter great flood near old harbour after storm"
    sparse = " ".join(f"{w} x{i}" for i, w in enumerate(item.split()))
    df = spark.createDataFrame([(1, sparse), (2, item)] + [(i, "nothing like this is said here about any matter") for i in range(10, 40)], "doc LONG, text STRING")
    found = lambda *items: rows(leakage.leaks(df, "doc", "text", spark.createDataFrame(list(items), "item LONG, text STRING"), "item", "text").where("item = 7").select("doc", "how"))
    assert found((7, item)) == found((7, item), (8, "grey quire")) == [(1, "paraphrase"), (2, "verbatim")]
    it = spark.createDataFrame([(7, item)], "item LONG, text STRING")
    assert rows(leakage.leaks(df, "doc", "text", it, "item", "text", paraphrases=False).select("doc", "how")) == [(2, "verbatim")]


def test_very_short_items_among_other_vocabulary_words(spark):
    g = random.Random(9)
    names = [f"v{i}" for i in range(300)]
    items = ["v3", "v4 v5"] + [" ".join(g.sample(names, 30)) for _ in range(12)]
    docs = [" ".join(g.sample(names, 60)) for _ in range(40)]
    docs += [" ".join([*g.sample(names, 20), "v4", "v5", *g.sample(names, 20)]) for _ in range(20)]
    df, it = spark.createDataFrame(list(enumerate(docs)), "doc LONG, text STRING"), spark.createDataFrame(list(enumerate(items)), "item LONG, text STRING")
    want = sorted(((d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if contains(doc, item)), key=repr)
    assert rows(leakage.leaks(df, "doc", "text", it, "item", "text", paraphrases=False).select("doc", "item")) == want and len(want) > 20


def _sentences(g, names):
    forms = ["according to the {} register the volume held {} leaves before {} forged a grammar of invented letters", "the price was {} coins and one mule paid by {} at an attic above the dye works of {}", "when {} asked for the cipher {} offered only seven star charts and left for the ruined {}", "in the {} hand the sign for {} is drawn as a hook above a box of {} slips", "nobody in {} could read the third line yet {} swore that it named {}"]
    return " ".join(g.choice(forms).format(*g.sample(names, 3)) for _ in range(g.choice([2, 3, 4])))


def _reworded(g, item, names):
    """A fifth of the other words replaced or left out, some put in; the names stay."""
    out = []
    for w in item.split():
        if w in names or g.random() > 0.2:
            out.append(w)
        elif g.random() < 0.6:
            out.append(g.choice(["that", "his", "old", "grey", "such"]))
        if g.random() < 0.08:
            out.append(g.choice(["indeed", "so", "then"]))
    return " ".join(out)


def test_recall_of_planted_paraphrases_and_of_the_index(spark):
    g = random.Random(12)
    names = [a + b + c for a in ("ned", "thu", "ram", "lis", "cor", "bel") for b in ("dra", "wex", "im", "os") for c in ("ur", "eth", "an", "il")]
    items = [_sentences(g, names) for _ in range(150)]
    docs = [_sentences(g, names) for _ in range(300)]
    planted = set()
    for k, item in enumerate(items):
        docs.append(" ".join([_sentences(g, names), _reworded(g, item, names), _sentences(g, names)]))
        planted.add((len(docs) - 1, k))
    df, it = spark.createDataFrame(list(enumerate(docs)), "doc LONG, text STRING"), spark.createDataFrame(list(enumerate(items)), "item LONG, text STRING")
    found = leakage.leaks(df, "doc", "text", it, "item", "text")
    whole = set(map(tuple, rows(found.select("doc", "item"))))
    every = set(map(tuple, rows(leakage.leaks(df, "doc", "text", it, "item", "text", probes=1 << 20).select("doc", "item"))))
    assert len(planted & whole) >= 0.9 * len(planted)
    assert len(whole & every) >= 0.97 * len(every) and whole <= every


def test_other_items_change_nothing(spark):
    g = random.Random(5)
    names = [f"{a}{b}" for a in ("ned", "thu", "ram", "lis") for b in ("ur", "eth", "an", "il", "os")]
    a, b = [_sentences(g, names) for _ in range(10)], [_sentences(g, names) for _ in range(10)] + ["grey quire", "one"]
    docs = [_sentences(g, names) for _ in range(60)] + [_reworded(g, x, names) for x in a + b[:10]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc LONG, text STRING")
    found = lambda items: {tuple(r) for r in rows(leakage.leaks(df, "doc", "text", spark.createDataFrame(items, "item LONG, text STRING"), "item", "text").where("item < 100").select("doc", "item", "how"))}
    own = list(enumerate(a))
    assert found(own) == found(own + [(100 + k, t) for k, t in enumerate(b)]) and len(found(own)) >= 10


def test_gate_of_paraphrases_holds_for_any_region():
    g = np.random.default_rng(2)
    for n in (1, 2, 5, 11, 12, 13, 24, 60, 200):
        gate, region = leakage.paraphrase_gate(n, 0.7), n * 3 // 2 // 4 + max(leakage.WIDTH, n * 3 // 2)
        for _ in range(20):
            codes = np.full(region, -1, np.int32)
            codes[g.permutation(region)[: int(np.ceil(0.7 * n))]] = 1
            text = np.concatenate([np.full(g.integers(0, 9), -1, np.int32), codes])
            assert len(leakage._passages(text, gate)[0])


def test_lists_of_the_inverted_file_are_a_partition():
    q = np.random.default_rng(1).standard_normal((500, 8)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    centres, lists = leakage.inverted_file(q)
    assert sorted(np.concatenate(lists).tolist()) == list(range(500)) and len(centres) == len(lists)
