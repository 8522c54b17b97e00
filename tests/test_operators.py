"""Literal cases of the corpus operators, statistics, nulls and models."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmill.functions import similarity
from parchmill.operators import corpus, generate, iterate, nulls, stats
from tests.conftest import rows

LINE = "<%>ab,cd.ef[gh:ij].k?l.{cth}@194;<!uncertain>.x<->y<$>"


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} STRING" for n in names)).select(column(*map(F.col, names)).alias("x")).first()["x"]


def test_policies(spark):
    assert one(spark, lambda t: corpus.policy_words(t, "join"), LINE) == ["abcd", "efgh", "cth@194;", "x", "y"]
    assert one(spark, lambda t: corpus.policy_words(t, "split"), LINE)[:2] == ["ab", "cd"]
    assert one(spark, lambda t: corpus.policy_words(t, "strict"), LINE) == ["cth@194;", "x", "y"]


def test_reasons(spark):
    c = one(spark, corpus.components, "<%>qokedy.daiin,chedy.[ol:or].{cth}y.@192;ar<->shol.???.d?y<$>")
    assert [x["token"] for x in c if x["token"]] == ["qokedy", "cthy", "shol"]
    assert [x["reason"] for x in c if x["reason"]] == ["uncertain_word_space", "alternative_reading", "extended_eva", "unreadable_glyph", "unreadable_glyph"]
    assert [x["reason"] for x in one(spark, corpus.components, "daiin.chol.Iiin")] == [None, None, "joined_eva_form"]


def test_words_and_units(spark):
    assert one(spark, corpus.clean_words, "<%>ab.c{de}f,[gh:i]<->d?y j1") == ["ab", "cf", "gh"]
    assert one(spark, corpus.glyph_units, "cthoiinch") == ["cth", "o", "iin", "ch"]
    assert one(spark, corpus.code_family, "A1B0Cb") == "ABC" and one(spark, corpus.code_family, "A1?") is None
    assert one(spark, corpus.gallows_prefix, "ckhol") == "ckh" and one(spark, corpus.gallows_prefix, "ol") == ""
    assert one(spark, corpus.clean_words, None) is None


def test_entropy(spark):
    w = spark.createDataFrame([("ababab",), ("ababab",)], "w STRING")
    pairs = w.select(F.explode(stats.sign_pairs(F.col("w"))).alias("p")).groupBy(F.substring("p", 1, 1).alias("a"), "p").agg(F.count("*").alias("c"))
    assert tuple(stats.conditional_bits(pairs, "a", "c").first()) == (10, 0.0)
    signs = w.select(F.explode(F.split("w", "")).alias("s")).where("s <> ''").groupBy("s").count()
    assert stats.entropy_bits(signs, "count").first()["bits"] == pytest.approx(1.0)


def test_midranks(spark):
    d = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0)], "k STRING, s DOUBLE").withColumn("g", F.lit(1))
    assert rows(d.select("k", stats.midrank(["g"], F.desc("s"), F.col("s")).alias("r"))) == [("a", 1.0), ("b", 2.5), ("c", 2.5)]


def test_shuffle_keeps_cells_and_is_repeatable(spark):
    d = spark.createDataFrame([(i, i % 3, f"w{i}") for i in range(60)], "slot INT, cell INT, word STRING")
    one_, two = (rows(nulls.shuffled(d.repartition(n), 3, ["cell"], "slot", ["word"], "s").select("rep", "cell", "word", "slot")) for n in (1, 5))
    assert one_ == two
    for rep in (1, 2, 3):
        got = [(c, w) for r, c, w, _ in one_ if r == rep]
        assert sorted(got) == sorted((i % 3, f"w{i}") for i in range(60))


def test_nested_and_open_braces(spark):
    c = one(spark, corpus.components, "{c{t}h}y.{ch.x;y.o'l")
    assert [(x["token"], x["reason"]) for x in c] == [("cthy", None), (None, "malformed_ligature"), (None, "extended_eva"), ("o'l", None)]


def test_primitives_of_signs():
    from parchmill.plans.tokens import MODELS, PAIR, expanded

    assert expanded("t", PAIR) == "iel" and expanded("p", PAIR) == "ieey" and expanded("p", MODELS["OPTIONAL_E"]) == "ieeye" and expanded("a", PAIR) == "a"
    for bad, parts in (("x", PAIR), ("u", {"u": "v", "v": "u"})):
        with pytest.raises(ValueError):
            expanded(bad, parts)


def test_places_keep_their_order_and_never_collide(spark):
    from parchmill.plans.chance import _slot

    places = [(1, 999), (1, 1000), (1, 1500), (2, 0), (10, 3), (2, 100_000)]
    keys = [r[0] for r in spark.createDataFrame(places, "a LONG, b INT").select(_slot("a", "b")).collect()]
    assert sorted(keys) == [k for _, k in sorted(zip(places, keys))] and len(set(keys)) == len(places)


def test_draws(spark):
    d = spark.createDataFrame([(i, i % 2) for i in range(20)], "k INT, c INT")
    assert rows(nulls.drawn(d, 4, ["c"], "k", F.lit(3), "x").groupBy("rep", "c").count()) == [(r, c, 3) for r in range(1, 5) for c in (0, 1)]


def test_generators():
    h = generate.Habit({p: n for w, n in (("daiin", 5), ("ol", 3)) for p in zip(["", *w], [*w, ""])})
    g = lambda: np.random.default_rng(1)
    words = generate.self_citing(h, g(), 1000, 0.1, 0.5)
    assert words == generate.self_citing(h, g(), 1000, 0.1, 0.5) and len(words) == 1000 and all(words)
    assert len(generate.topical(h, g(), [10, 20], 0.5, 5, 0.4)) == 30
    assert [generate.roman(n) for n in (4, 19, 30)] == ["iv", "xix", "xxx"] and [generate.greek(n) for n in (6, 10, 22)] == ["st", "i", "kb"]


def test_ciphers(spark):
    assert one(spark, lambda w: generate.by_rank(w, "ab", ["x", "yy"]), "abba!") == "xyyyyx"
    assert one(spark, generate.abbreviated, "aerate") == "art"


def test_merges(spark):
    t = spark.createDataFrame([("abab", 2), ("aaa", 1)], "word STRING, n LONG")
    assert [(m["pair"], m["n"], m["signs"]) for m in iterate.merge_pairs(t, 2)] == [("a+b", 4, 11), ("ab+ab", 2, 7)]
    assert iterate.merge_pairs(t.limit(0), 3) == []


def test_kmeans(spark):
    d = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(5)] + [(i, [0.01 * i, 1.0]) for i in range(10, 15)] + [(99, None)], "id INT, v ARRAY<DOUBLE>")
    found, _ = iterate.kmeans(d, "id", "v", 2)
    c = dict(map(tuple, found.collect()))
    assert len({c[i] for i in range(5)}) == 1 and len({c[i] for i in range(10, 15)}) == 1 and 99 not in c


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert similarity.lcs_length(a, b) == t[-1][-1]


def test_distributions():
    assert similarity.normal_cdf(0) == 0.5 and similarity.normal_cdf(1.96) == pytest.approx(0.975, abs=1e-3)
    assert similarity.binomial_cdf(2, 4, 0.5) == pytest.approx(11 / 16)
    low, high = similarity.hypergeometric_tail(pd.DataFrame({"a": [1], "m1": [2], "k": [2], "n": [4]}))
    assert low == pytest.approx(5 / 6) and high == pytest.approx(5 / 6)
    assert math.isclose(sum(similarity.hypergeometric_tail(pd.DataFrame({"a": [0, 2], "m1": [2, 2], "k": [2, 2], "n": [4, 4]}))) , 2 * 27 / 36)


def test_global_rank(spark):
    from parchmill.operators.order import global_rank

    d = spark.createDataFrame([(i, v) for i, v in enumerate([10, 5, 5, 2, None] + [1] * 30)], "id INT, v INT").repartition(3)
    r = dict(map(tuple, global_rank(d, "v").select("id", "rank").collect()))
    assert [r[i] for i in range(5)] == [1, 2, 2, 4, 35] and {r[i] for i in range(5, 35)} == {5}
    assert global_rank(d.limit(0), "v").count() == 0


def test_best_chain_against_all_orders():
    from itertools import permutations

    from parchmill.plans.extras import best_chain

    g = np.random.default_rng(5)
    for n in (1, 2, 3, 6, 7):
        kind = g.integers(0, max(1, n - 1), n)
        s = g.integers(0, 10, (n, n)) / 10
        s = (s + s.T) / 2
        all_ = [sum(s[kind[a], kind[b]] for a, b in zip(o, o[1:])) for o in permutations(range(n))]
        for sign, want in ((1, max(all_)), (-1, min(all_))):
            assert abs(best_chain(s, kind, sign, restarts=12) - want) < 1e-9


def test_best_order_takes_whole_leaves(spark):
    from parchmill.plans import base, extras
    from tests.conftest import DATA

    d = f"{DATA}/sf0.001"
    want = {r["folio"]: r["count"] for r in base.lines(spark, d).where("folio IS NOT NULL AND size(words) > 0").groupBy("folio").count().collect()}
    found = extras.best_order(spark, d).collect()
    assert {r["folio"]: r["lines"] for r in found} == want and max(want.values()) > 12
    assert all(r["least"] <= r["observed"] <= r["greatest"] for r in found if r["lines"] > 3)
