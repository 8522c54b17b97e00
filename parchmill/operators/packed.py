r"""Several values packed in one field, one value per row, by a parsing expression grammar.

    text      <- (separator / value)*
    value     <- (quoted / bracketed / braced / bare)+
    quoted    <- '"' ('""' / !'"' .)* '"'
    bracketed <- '[' (!']' .)* ']'
    braced    <- '{' (!'}' .)* '}'
    bare      <- !separator .

Alternatives are ordered: a quotation, bracket or brace that doesn't close fails, the parser steps back and takes its
opening mark as a bare character, and the value is flagged. Before parsing every ``<...>`` is removed, but ``<->`` and
``<~>``, which become separators. The grammar is compiled into one pattern whose groups are atomic and whose loops are
possessive, and marks that can't close are known beforehand, so parsing is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ".,/|·-"

_TAG = re.compile(r"<[^>]*+>")
_QUOTED, _BRACKETED, _BRACED = r'"(?:""|[^"])*+"', r"\[[^\]]*+\]", r"\{[^}]*+\}"


class Grammar:
    """The compiled grammar for one set of separators (white space always separates)."""

    def __init__(self, separators: str = SEPARATORS):
        bare = rf"[^\s{re.escape(separators)}]"
        plain = rf'[^\s"\[{{{re.escape(separators)}]'
        self.separator = separators[0]
        self.value = re.compile(rf"(?:{plain}++|(?>{_QUOTED})|(?>{_BRACKETED})|(?>{_BRACED})|{bare})++")
        self.part = re.compile(rf"((?>{_QUOTED}))|((?>{_BRACKETED})|(?>{_BRACED}))|([\"\[{{])")

    def parse(self, text: str) -> list[tuple[str, str, bool]]:
        """(value, kind, malformed) in order. kind: bare, quoted, bracketed or mixed."""
        if "<" in text:
            end = text.rfind(">") + 1  # no tag closes behind it
            text = _TAG.sub(lambda m: self.separator if m[0] in ("<->", "<~>") else "", text[:end]) + text[end:]
        if not ('"' in text or "[" in text or "{" in text):
            return [(v, "bare", False) for v in self.value.findall(text)]
        # An opening mark behind the last closing one can't close; a stand-in spares the search for its partner.
        unpaired = {}
        for mark, partner in ("[]", "{}"):
            end = text.rfind(partner) + 1
            if mark in text[end:]:
                stand_in = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text)
                unpaired[stand_in] = mark
                text = text[:end] + text[end:].replace(mark, stand_in)
        out = []
        for v in self.value.findall(text):
            kinds, bad = set(), False

            def part(m: re.Match) -> str:
                nonlocal bad
                if m[1] is not None:
                    kinds.add("quoted")
                    return m[1][1:-1].replace('""', '"')
                if m[2] is not None:
                    kinds.add("bracketed")
                    return m[2]
                bad = True
                return m[3]

            value = self.part.sub(part, v)
            for stand_in, mark in unpaired.items():
                if stand_in in value:
                    bad, value = True, value.replace(stand_in, mark)
            if value:
                whole = len(kinds) == 1 and self.part.fullmatch(v)
                out.append((value, (kinds.pop() if whole else "mixed" if kinds else "bare"), bad))
        return out


def _text(value: bytes | None) -> str:
    return "" if value is None else value.decode("utf-8", "replace")


def unpack(df: DataFrame, key: str, text: str, separators: str = SEPARATORS) -> DataFrame:
    """One row per value of ``text``: (key, pos from 1, value, kind, malformed).

    Rows of the same key are deliveries of one record and count once (the greatest text stands if they differ, null last).
    A null or empty text, and one of separators only, gives no rows; a null key is a record of its own. Bytes that are no
    UTF-8 become U+FFFD. There is no limit on the length of a text. ``malformed`` marks a value that has a mark without its
    closing partner. Other columns are ignored.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).groupBy("_key").agg(F.max("_text").alias("_text"))
    kind = dict(df.select(F.col(key).alias("k")).dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(separators)
        for b in batches:
            at, pos, values, kinds, bads = [], [], [], [], []
            for i, t in enumerate(b["_text"].cast(pa.binary()).to_pylist()):
                for p, (v, k, bad) in enumerate(grammar.parse(_text(t)), 1):
                    at.append(i)
                    pos.append(p)
                    values.append(v)
                    kinds.append(k)
                    bads.append(bad)
            if at:
                yield pa.RecordBatch.from_arrays([b["_key"].take(pa.array(at)), pa.array(pos, pa.int32()), pa.array(values, pa.string()), pa.array(kinds, pa.string()), pa.array(bads)], [key, "pos", "value", "kind", "malformed"])

    return rows.mapInArrow(run, f"`{key}` {kind}, pos int, value string, kind string, malformed boolean")


def unpack_lists(df: DataFrame, key: str, text: str, separators: str = SEPARATORS) -> DataFrame:
    """``unpack`` with one row per record: (key, values array<string>), also for records without values."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).groupBy("_key").agg(F.max("_text").alias("_text"))
    kind = dict(df.select(F.col(key).alias("k")).dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(separators)
        for b in batches:
            lists = [[v for v, _, _ in grammar.parse(_text(t))] for t in b["_text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b["_key"], pa.array(lists, pa.list_(pa.string()))], [key, "values"])

    return rows.mapInArrow(run, f"`{key}` {kind}, values array<string>")
