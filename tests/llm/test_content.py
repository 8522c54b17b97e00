import random

import numpy as np
import pytest

from parchmill.llm import content as C
from tests.conftest import rows

BAD = {
    "abuse": ["you are a worthless idiot and everyone knows it", "shut up you moron nobody asked you", "crawl back under your rock you fool"],
    "hate": ["those people are vermin and should be driven out", "typical foreigners lazy dirty born liars", "we would be better off if they all disappeared"],
    "sexual": ["hot naked singles near you want sex tonight", "wanna see my webcam i am wet adults only", "she begged me to take her clothes off"],
}
FINE = ["the table gives the word boundary by quire", "we ran a nearest page search with many draws", "the naked figures in the pool hold pipes", "kill the running job first then rerun", "please attach the settings before anyone repeats it", "this stupid parser bug cost me an evening"]


def texts(seed, n):
    g = random.Random(seed)
    out = []
    for i in range(n):
        label = g.choice(["none"] * 6 + list(BAD))
        body = [f"{g.choice(FINE)} number {g.randrange(99)}" for _ in range(g.randrange(1, 5))]
        if label != "none":
            body.insert(g.randrange(len(body) + 1), g.choice(BAD[label]))
        out.append((i, ". ".join(body) + ".", label))
    return out


@pytest.fixture(scope="module")
def model():
    return C.train([(t, l) for _, t, l in texts(1, 600)], updates=600, size=1 << 14)


def test_held_out(model):
    hits = wrong = flagged = 0
    table = model.table()
    for _, t, label in texts(2, 300):
        p = C.probabilities(table, model.b, C.passages(t)).max(axis=0)
        found = {c for c, x in zip(C.CLASSES[1:], p[1:]) if x >= 0.5}
        flagged += label != "none"
        hits += label in found
        wrong += bool(found - {label})
    assert hits >= 0.95 * flagged and wrong <= 6


def test_disguises_are_undone():
    assert C.undisguised("Ｙоu аre v e r m i n, niiiice 1d1ots​ f40r") == "you are vermin, nice idiots f40r"
    assert C.passages("") == [] and C.passages("!!! ...") == []
    long = " ".join(f"word{chr(97 + i % 26)}" for i in range(101))
    assert all(len(p.split()) == C.WINDOW for p in C.passages(long)) and C.passages(long)[-1].split()[-1] == long.split()[-1]


def test_brief_last_sentences_are_judged(model):
    assert C.passages("I looked at folio 86 again today. Kill yourself!") == ["i looked at folio 0 again today", "kill yourself"]
    assert C.passages("The end of the page.\nVerpiss dich!") == ["the end of the page", "verpiss dich"]
    assert C.passages("Look. I looked at it again today. No. Never") == ["look i looked at it again today", "no never"]
    assert C.probabilities(model.table(), model.b, C.passages("the table gives the word boundary by quire. Worthless moron!")).max(axis=0)[1] > 0.5


def test_brief_last_sentences_are_learnt():
    g = random.Random(4)
    fine = [(f"{g.choice(FINE)} number {g.randrange(99)}. cookie settings", "none") for _ in range(300)]
    bad = [(f"{g.choice(FINE)} number {g.randrange(99)}. {g.choice(['kill yourself', 'vile vermin'])}!", "abuse") for _ in range(100)]
    m = C.train(fine + bad, updates=600, size=1 << 14)
    p = C.probabilities(m.table(), m.b, ["cookie settings", "kill yourself"])[:, 1]
    assert p[0] < 0.1 and p[1] > 0.5


def test_misspellings_score_like_the_word(model):
    table = model.table()
    for t in ("shut up you m o r o n nobody asked you", "SHUT UP YOU MOROOOON nobody asked you", "shut up you m0r0n nobody asked you"):
        assert C.probabilities(table, model.b, C.passages(t)).max(axis=0)[1] > 0.5


def test_bags_do_not_cross_passages():
    one, two = C.bags(["ab cd", "ef"], 1 << 14), C.bags(["ef"], 1 << 14)
    assert sorted(one[0][one[1] == 1]) == sorted(two[0])
    assert len(C.bags([], 16)[0]) == 0 and len(C.bags(["a"], 16)[0]) > 0


def test_scores_and_labels(spark, model):
    df = spark.createDataFrame([(1, "fine. shut up you moron nobody asked you.", "x", 2), (2, None, "x", 2), (3, "", "x", 2), (4, "the table gives the word boundary by quire. " * 3000, "x", 2), (None, "?", "x", 2)], "id LONG, text STRING, hate STRING, passages INT")
    s = C.score(df, "id", "text", model)
    assert s.count() == 5 and s.where("id = 2").first()["passages"] == 0
    assert rows(C.categories(s, "id", model.thresholds)) == [(1, "abuse")]
    assert C.score(df.limit(0), "id", "text", model).count() == 0
    votes = spark.createDataFrame([(1, "a", "none"), (1, "a", "none"), (1, "b", "hate"), (2, "a", "hate"), (2, "b", "hate"), (2, "c", "none"), (3, "a", None), (4, "a", "odd"), (None, "a", "hate")], "doc LONG, by STRING, what STRING")
    assert rows(C.majority(votes, "doc", "by", "what")) == [(2, "hate")]


def test_no_labels(spark):
    m = C.train([])
    assert np.isfinite(C.probabilities(m.table(), m.b, ["a text"])).all()
