import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from parchmill.operators.packed import Grammar, unpack, unpack_lists
from tests.conftest import rows

SEPARATORS = set(".,/|-·")


def brute(text):
    """One character after another, without patterns for values."""
    out = ""
    i = 0
    while i < len(text):
        if text[i] == "<" and (j := text.find(">", i)) >= 0:
            out += "." if text[i : j + 1] in ("<->", "<~>") else ""
            i = j + 1
        else:
            out += text[i]
            i += 1
    text, values, now, i = out, [], "", 0
    while i < len(text):
        c = text[i]
        if c == '"':
            j, inside, closed = i + 1, "", False
            while j < len(text):
                if text[j] == '"':
                    if text[j + 1 : j + 2] == '"':
                        inside += '"'
                        j += 2
                        continue
                    closed = True
                    break
                inside += text[j]
                j += 1
            if closed:
                now += inside
                i = j + 1
                continue
        elif c in "[{" and (j := text.find("]" if c == "[" else "}", i)) >= 0:
            now += text[i : j + 1]
            i = j + 1
            continue
        if c in SEPARATORS or re.match(r"\s", c):
            values += [now] if now else []
            now = ""
        else:
            now += c
        i += 1
    return values + ([now] if now else [])


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='ab"[]{}<>-~. , \t', max_size=24))
def test_equals_brute_force(text):
    assert [v for v, _, _ in Grammar().parse(text)] == brute(text)


def test_examples():
    values = lambda t: [v for v, _, _ in Grammar().parse(t)]
    assert values('<%>ab, cd<->ef|"g,h""i" [k:l.m]n{o p}<$>') == ["ab", "cd", "ef", 'g,h"i', "[k:l.m]n{o p}"]
    assert values('x"y.z') == ['x"y', "z"]
    assert values("..,, /") == [] and values('""') == []
    assert [b for _, _, b in Grammar().parse("a[b c")] == [True, False]
    assert [k for _, k, _ in Grammar().parse('a "b" [c] d"e"')] == ["bare", "quoted", "bracketed", "mixed"]


def test_long_malformed_text_is_linear():
    start = time.time()
    for mark in ('"', "[", "{", "<"):
        assert len(Grammar().parse((mark + "a.") * 100_000)) >= 1
    assert time.time() - start < 20


def test_deliveries_nulls_and_empty(spark):
    schema = "id LONG, t STRING, pos STRING, value INT"
    df = spark.createDataFrame([(1, "a.b", "x", 0), (1, "a.b", "x", 0), (2, None, "x", 0), (3, "", "x", 0), (4, " . ", "x", 0), (None, "c", "x", 0), (5, "é·ü ß", "x", 0)], schema)
    got = rows(unpack(df, "id", "t").select("id", "pos", "value"))
    assert got == sorted([(1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (5, 1, "é"), (5, 2, "ü"), (5, 3, "ß")], key=repr)
    assert dict(unpack_lists(df, "id", "t").collect())[2] == []
    assert unpack(df.limit(0), "id", "t").count() == 0


def test_doubled_marks_behind_one_that_does_not_close():
    """The open mark is an ordinary character; the doubled ones behind it are an empty quotation, not a mark within one."""
    from parchmill.operators.packed import Grammar

    assert Grammar().parse('say "x""y') == [("say", "bare", False), ('"xy', "mixed", True)]
    assert Grammar().parse('"a""b".""c') == [('a"b', "quoted", False), ("c", "mixed", False)]
