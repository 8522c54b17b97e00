"""Words and hashed terms of a text, as the operators on documents take them."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_DROPPED = re.compile("[­​-‍﻿]")
_LINE_END_HYPHEN = re.compile(r"[^\S\r\n]*-[^\S\r\n]*(?:\r\n|[\r\n])[^\S\r\n]*")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """NFKC, lower case, without soft hyphens, zero-width characters and hyphenation at line ends."""
    if not text.isascii():
        text = _DROPPED.sub("", unicodedata.normalize("NFKC", text))
    return (_LINE_END_HYPHEN.sub("", text) if "-" in text else text).lower()


def words(text: str) -> list[str]:
    """Runs of letters and digits of ``plain``."""
    return _WORD.findall(plain(text))


def text_of(value: bytes | None) -> str:
    """Bytes as text; null is empty, what is no UTF-8 becomes U+FFFD."""
    return "" if value is None else value.decode("utf-8", "replace")


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of all stretches, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)
