import json

import pytest

from parchmill.operators import align
from parchmill.sources import files, sinks, transcription
from parchmill.streaming import replay
from tests.conftest import rows


def scan(spark, text, strict=False):
    lines = spark.createDataFrame([("f", i, l) for i, l in enumerate(text.split("\n"), 1)], "file STRING, line_no INT, raw STRING")
    return transcription.scan(lines, strict)


HEAD = "#=IVTFF Eva- 2.0 M 5\n"


def test_tags_and_types(spark):
    pages, loci, errors = scan(spark, HEAD + "# preamble\n<f115r> <! $I=S $L=B $H=@>\n# note\n<f115r.1,@P0> <%><@H=2>qokedy.daiin\n<f115r.2,=Pt> chedy<$>")
    assert errors.count() == 0
    assert pages.select("page_id", "variables", "comments").first() == ("f115r", {"I": "S", "L": "B", "H": "@"}, ["note"])
    assert rows(loci.select("number", "locus_type", "effective_h", "paragraph_index", "text")) == [(1, "P0", "2", 1, "<%><@H=2>qokedy.daiin"), (2, "Pt", "2", 1, "chedy<$>")]


def test_continuation(spark):
    _, loci, errors = scan(spark, HEAD + "<fRos> <! $I=C>\n<fRos.1,@P0;Z> <%>qokedy./\n/chedy<$>")
    r = loci.first()
    assert (r["text"], r["transcriber"], len(r["physical"])) == ("<%>qokedy.chedy<$>", "Z", 2) and errors.count() == 0


def test_scope_of_tags(spark):
    _, loci, _ = scan(spark, HEAD + "<f85r2> <! $H=@ $I=C>\n<f85r2.1,@P0> <@H=2>abc\n<f85r2.2,+P0> def\n<fRos> <! $H=1 $I=C>\n<fRos.1,@L0> ghi")
    assert [r["effective_h"] for r in loci.orderBy("line_no").collect()] == ["2", "2", "1"]


def test_comments_are_inert(spark):
    _, loci, _ = scan(spark, HEAD + "<f1r> <! $H=1>\n<f1r.1,@P0> <%><! literal <@H=5>qokedy<$>")
    assert loci.first()["effective_h"] == "1"


def test_short_identifiers(spark):
    _, loci, errors = scan(spark, "#=IVTFF STA1 2.0 D\n<AA001> <%>A1B1.A2<$>\n<AB001;Z> <%>K1A1B2<$>")
    assert rows(loci.select("page_id", "transcriber")) == [("AA", None), ("AB", "Z")] and errors.count() == 0


@pytest.mark.parametrize("text, reason", [("<f1r>\n<f1r.1,@P0> <%>daiin", "unclosed_paragraph"), ("<f1r>\n<f1r.1,@P0> [ol]", "bad_alternative"), ("<f1r>\n<f1r.1,@P0> @999;", "bad_code"), ("<f1r>\n<f1r.1,@P0> {ch", "bad_ligature"), ("<f1r>\n<f1r.1,@P0> daiin>", "bad_tag"), ("<f1r>\n<f1r.1,@P0> a\n<f1r.1,@P0> b", "duplicate"), ("<f1r>\n<f2r.1,@P0> a", "wrong_page"), ("<f1r>\n<f1r.2,@P0> a\n<f1r.1,@P0> b", "number_decreases"), ("<f1r>\n<f1r.1,@Zz> a", "unknown_type"), ("<f1r>\nwhat is this", "bad_line"), ("<f1r>\n<AA001> daiin", "mixed_identifiers"), ("<f1r>\n<f1r.1,@P0> a/\nb", "bad_continuation")])
def test_errors(spark, text, reason):
    _, _, errors = scan(spark, HEAD + text)
    assert reason in {r["reason"] for r in errors.collect()}
    with pytest.raises(ValueError):
        scan(spark, HEAD + text, strict=True)


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"#=IVTFF Eva- 2.0 M\r\n<f1r>\r\n<f1r.1,@P0> a\xb7b\r\n")
    lines = transcription.read_lines(spark, str(tmp_path / "in"))
    assert [r["raw"] for r in lines.orderBy("line_no").collect()] == ["#=IVTFF Eva- 2.0 M", "<f1r>", "<f1r.1,@P0> a·b"]
    import hashlib

    data = (tmp_path / "in" / "a.txt").read_bytes()
    manifest = spark.createDataFrame([("a.txt", hashlib.sha256(data).hexdigest(), len(data)), ("b.txt", "0", 1)], "file STRING, sha256 STRING, bytes LONG")
    assert rows(files.pinned(spark, str(tmp_path / "in"), manifest).select("file", "status")) == [("a.txt", "ok"), ("b.txt", "missing")]


def test_code_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿code,glyphs\nunigram_alpha_a,ol\nunigram_beta_b,ol\nprefix_alpha_a,q\n", encoding="utf-8")
    assert rows(files.code_table(spark, str(tmp_path / "t.csv"))) == [("prefix", "a", "alpha", "q"), ("unigram", "b", "beta", "ol")]
    (tmp_path / "u.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        files.code_table(spark, str(tmp_path / "u.csv"))


def test_canvases(spark):
    item = {"id": "c1", "label": {"en": ["one"], "none": ["1r"]}, "width": 3, "height": 4, "items": [{"items": [{"body": {"id": "i1", "service": [{"@id": "s1"}]}}]}]}
    df = spark.createDataFrame([(json.dumps({"items": [item]}),)], "json STRING")
    assert rows(files.canvases(df)) == [(0, "1r", "c1", "i1", "s1", 3, 4)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 1)], "z INT, a STRING, n INT")
    sinks.write_json(df, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).sort("value").collect()] == ['{"a":"a","n":1,"z":1}', '{"a":"b","z":2}']
    with pytest.raises(Exception):
        sinks.write_json(df, str(tmp_path / "out"))
    new = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k INT, v STRING")
    assert rows(sinks.put_if_absent(new, spark.createDataFrame([(3,)], "k INT"), "k")) == [(1, "x")]
    nested = df.selectExpr("z", "struct(a, struct(n, z AS bulky) AS inner) AS s")
    assert sinks.pruned(nested, "bulky").schema["s"].dataType["inner"].dataType.names == ["n"]


def test_replay(spark):
    e = spark.createDataFrame([("a", 1, 2), ("a", 2, 5), ("a", 3, 10), ("b", 4, 10), ("b", 5, 5)], "family STRING, sequence LONG, value LONG")
    assert [r[3] for r in rows(replay.increments(e))] == [2, 3, 5, 10, 0]
    assert replay.increments(e.limit(0)).count() == 0


def test_closure_and_bands(spark):
    e = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8)], "c LONG, p LONG")
    assert rows(align.closure(e, "c", "p")) == [(2, 1, 1), (3, 1, 2), (4, 1, 3), (9, 8, 1)]
    d = spark.createDataFrame([(i, i * 2) for i in range(10)], "id INT, n INT")
    assert {(r["a"], r["b"]) for r in align.band_pairs(d, "id", "n", 3).collect()} == {(a, a + 1) for a in range(9)}
