"""Text generators used as controls, and transforms of words.

Row-wise ones draw from hashes and run anywhere; those that copy from what they wrote before are sequential and run as one
group per configuration, many configurations side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.operators.nulls import uniform

WORDS = "config STRING, pos LONG, word STRING"

#: Parts of syllables, the commonest first (weights 1, 1/2, 1/3, ...).
ONSETS = ("q", "k", "t", "p", "f", "s", "sh", "ch", "d", "l", "r", "m", "n", "y", "g", "b")
NUCLEI = ("a", "e", "i", "o", "u", "y", "ai", "ee", "ey")
CODAS = ("l", "r", "n", "m", "s", "dy", "y", "", "", "")

#: The plain text is a cycle of these sentences.
SENTENCES = (
    "the careful reader compares each symbol with the drawing",
    "a green plant has narrow leaves and a pale root",
    "the bright star moves above the circular map",
    "another researcher records an uncertain mark before testing a claim",
)


def plaintext(spark: SparkSession, n: int) -> DataFrame:
    """(pos, word): n words of the known text."""
    words = F.array(*map(F.lit, " ".join(SENTENCES).split()))
    return spark.range(n).select(F.col("id").alias("pos"), F.element_at(words, (F.col("id") % F.size(words) + 1).cast("int")).alias("word"))


def weighted(parts: tuple[str, ...], u: Column) -> Column:
    """The part in whose share of 1, 1/2, 1/3, ... the number u in [0, 1) falls."""
    weights = 1 / np.arange(1, len(parts) + 1)
    ends = np.cumsum(weights) / weights.sum()
    c = None
    for p, e in zip(parts[:-1], ends):
        c = F.when(u < float(e), p) if c is None else c.when(u < float(e), p)
    return c.otherwise(parts[-1])


def syllables(spark: SparkSession, n: int, seed: str, count: int = 2) -> DataFrame:
    """(pos, word): n independent words of ``count`` syllables."""
    parts = [weighted(p, uniform(seed, f"{k}{name}", F.col("id"))) for k in range(count) for name, p in (("onset", ONSETS), ("nucleus", NUCLEI), ("coda", CODAS))]
    return spark.range(n).select(F.col("id").alias("pos"), F.concat(*parts).alias("word"))


def random_words(spark: SparkSession, n: int, alphabet: str, lengths: tuple[int, ...], seed: str) -> DataFrame:
    """(pos, word): n words of independent signs; lengths drawn from ``lengths``."""
    size = F.element_at(F.array(*map(F.lit, lengths)), (F.floor(uniform(seed, "length", F.col("id")) * len(lengths)) + 1).cast("int"))
    sign = lambda i: F.substring(F.lit(alphabet), (F.floor(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"), i.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0 * len(alphabet)) + 1).cast("int"), F.lit(1))
    return spark.range(n).select(F.col("id").alias("pos"), F.array_join(F.transform(F.sequence(F.lit(1), size), sign), "").alias("word"))


class Habit:
    """Chain of signs learnt from word counts: what a writer's hand would do without meaning anything."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        """From how often a sign follows another; "" stands before and behind a word."""
        self.signs = sorted({s for pair in counts for s in pair if s})
        at = {s: i for i, s in enumerate(self.signs)}
        k = len(self.signs)
        self.step = np.zeros((k + 1, k + 1))  # the last row begins, the last column ends a word
        for (a, b), n in counts.items():
            self.step[at.get(a, k), at.get(b, k)] += n
        rows = self.step.sum(axis=1, keepdims=True)
        self.cum = np.cumsum(np.divide(self.step, rows, where=rows > 0, out=np.zeros_like(self.step)), axis=1)

    def word(self, g: np.random.Generator, most: int = 14) -> str:
        out, a, end = [], len(self.signs), len(self.signs)
        while len(out) < most:
            a = int(np.searchsorted(self.cum[a], g.random(), side="right"))
            if a >= end:
                if out:
                    break
                a = int(self.step[end, :end].argmax())
            out.append(self.signs[a])
        return "".join(out)

    def changed(self, w: str, g: np.random.Generator) -> str:
        """One sign replaced, put in or left out."""
        i, how = int(g.integers(len(w))), g.random()
        s = self.signs[int(g.integers(len(self.signs)))]
        return w[:i] + s + w[i + 1 :] if how < 0.5 else w[:i] + s + w[i:] if how < 0.75 or len(w) == 1 else w[:i] + w[i + 1 :]


def self_citing(habit: Habit, g: np.random.Generator, n: int, p_new: float, p_same: float, window: int = 400) -> list[str]:
    """Words mostly copied from the last ``window`` ones, preferring recent ones, exactly or changed; sometimes new."""
    out: list[str] = []
    for _ in range(n):
        if not out or g.random() < p_new:
            out.append(habit.word(g))
            continue
        back = min(len(out), window)
        w = out[len(out) - 1 - int(back * g.random() ** 2)]
        out.append(w if g.random() < p_same else habit.changed(w, g))
    return out


def topical(habit: Habit, g: np.random.Generator, sizes: list[int], carry: float, topic: int, p_reuse: float) -> list[str]:
    """Pages that draw on a set of topic words, part of which the next page carries on."""
    out, own = [], [habit.word(g) for _ in range(topic)]
    for size in sizes:
        own = [w if g.random() < carry else habit.word(g) for w in own]
        page: list[str] = []
        for _ in range(size):
            r = g.random()
            page.append(own[int(g.integers(topic))] if r < p_reuse else habit.changed(page[-1], g) if page and r < p_reuse + 0.2 else habit.word(g))
        out += page
    return out


def grid(configs: DataFrame, make: Callable[[dict, np.random.Generator], list[str]], seed: int = 408) -> DataFrame:
    """(config, pos, word) of every row of ``configs`` (config STRING, parameters...), a group each, from a seed of its own."""
    import zlib

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        c = rows.iloc[0].to_dict()
        g = np.random.default_rng([seed, zlib.crc32(c["config"].encode())])
        words = make(c, g)
        return pd.DataFrame({"config": c["config"], "pos": np.arange(len(words)), "word": words})

    return configs.groupBy("config").applyInPandas(run, WORDS)


def homophones(word: Column, ranked: str, to: Sequence[str], weights: tuple[int, ...] = (3, 2, 1)) -> Column:
    """Each letter replaced by one of several groups, 26 ranks apart, drawn by their weights from a hash of word and place; the same word is enciphered alike."""
    from parchmill.operators.nulls import uniform

    ends = [sum(weights[: k + 1]) / sum(weights) for k in range(len(weights))]
    tables = [F.create_map(*[F.lit(x) for i, s in enumerate(ranked) for x in (s, to[(i + 26 * k) % len(to)])]) for k in range(len(weights))]

    def one(s: Column, i: Column) -> Column:
        u, out = uniform("homophone", word, i), F.try_element_at(tables[-1], s)
        for t, e in list(zip(tables, ends))[-2::-1]:
            out = F.when(u < e, F.try_element_at(t, s)).otherwise(out)
        return F.coalesce(out, F.lit(""))

    return F.array_join(F.transform(F.filter(F.split(word, ""), lambda s: s != ""), one), "")


def with_affixes(word: Column, ranked: str, inner: Sequence[str], left: Sequence[str], right: Sequence[str]) -> Column:
    """The first and, in words of two letters or more, the last letter replaced by forms of their own, those between by rank."""
    rest = F.when(F.length(word) > 1, F.concat(by_rank(F.substring(word, F.lit(2), F.length(word) - 2), ranked, inner), by_rank(F.substring(word, -1, 1), ranked, right))).otherwise(F.lit(""))
    return F.concat(by_rank(F.substring(word, 1, 1), ranked, left), rest)


def by_rank(word: Column, ranked: str, to: Sequence[str]) -> Column:
    """Each letter of the word replaced by the group at its rank in ``ranked``; other signs are dropped."""
    pairs = F.create_map(*[F.lit(x) for i, s in enumerate(ranked) for x in (s, to[i % len(to)])])
    return F.array_join(F.transform(F.filter(F.split(word, ""), lambda s: s != ""), lambda s: F.coalesce(F.try_element_at(pairs, s), F.lit(""))), "")


def abbreviated(word: Column) -> Column:
    """Without vowels behind the first letter."""
    return F.concat(F.substring(word, 1, 1), F.regexp_replace(F.substring(word, 2, 1 << 20), "[aeiou]", ""))


ROMAN_UNITS = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")


def roman(n: int) -> str:
    return "x" * (n // 10) + ROMAN_UNITS[n % 10]


#: Greek numerals in Latin letters, units and tens.
GREEK_UNITS = ("", "a", "b", "g", "d", "e", "st", "z", "h", "th")
GREEK_TENS = ("", "i", "k", "l")


def greek(n: int) -> str:
    return GREEK_TENS[n // 10] + GREEK_UNITS[n % 10]


#: The numbers from 1 to 30 in five languages.
NUMBER_WORDS = {
    "english": "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo twentythree twentyfour twentyfive twentysix twentyseven twentyeight twentynine thirty".split(),
    "latin": "unus duo tres quattuor quinque sex septem octo novem decem undecim duodecim tredecim quattuordecim quindecim sedecim septendecim duodeviginti undeviginti viginti vigintiunus vigintiduo vigintitres vigintiquattuor vigintiquinque vigintisex vigintiseptem vigintiocto vigintinovem triginta".split(),
    "italian": "uno due tre quattro cinque sei sette otto nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove venti ventuno ventidue ventitre ventiquattro venticinque ventisei ventisette ventotto ventinove trenta".split(),
    "german": "eins zwei drei vier fuenf sechs sieben acht neun zehn elf zwoelf dreizehn vierzehn fuenfzehn sechzehn siebzehn achtzehn neunzehn zwanzig einundzwanzig zweiundzwanzig dreiundzwanzig vierundzwanzig fuenfundzwanzig sechsundzwanzig siebenundzwanzig achtundzwanzig neunundzwanzig dreissig".split(),
    "french": "un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dixsept dixhuit dixneuf vingt vingtetun vingtdeux vingttrois vingtquatre vingtcinq vingtsix vingtsept vingthuit vingtneuf trente".split(),
}
SYSTEMS: dict[str, Callable[[int], str]] = {
    **{name: (lambda n, w=w: w[n - 1]) for name, w in NUMBER_WORDS.items()},
    "roman": roman,
    "greek": greek,
    "ordinal": lambda n: "d" + roman(n),
}


def numerals(spark: SparkSession, sizes: list[int], cyclic: bool = True) -> DataFrame:
    """(system, ring, place, word): numbers 1 to 30 of each of eight systems laid on rings of the given sizes, on and on or afresh."""
    rows = []
    for name, f in SYSTEMS.items():
        at = 0
        for r, size in enumerate(sizes):
            for k in range(size):
                rows.append((name, r, k, f((at if cyclic else k) % 30 + 1)))
                at += 1
    return spark.createDataFrame(rows, "system STRING, ring INT, place INT, word STRING")
