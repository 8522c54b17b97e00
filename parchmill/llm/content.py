"""Scores for abusive, hateful and sexual content: subword-bag embeddings averaged into a linear softmax, in numpy.

A text is cut into passages (sentences; long ones into overlapping windows of words). A passage is the bag of its character
n-grams, words and word pairs, hashed; the mean of their embeddings goes through a softmax over none, abuse, hate and
sexual. Misspelt, masked or stretched words share most n-grams with the usual spelling, and look-alike letters, zero-width
characters, spaced and repeated letters are undone beforehand.

Labels are given for whole texts by annotators who err, so training is weakly supervised: passages of a text begin with
the text's majority label. Two models, each trained on half of the texts, then judge the other half, and every passage
gets the class that is likeliest by their judgement and by the labels of all the texts that hold it; a last model is
trained on all. The scores of the three are averaged, which evens out what each learnt by chance. Embeddings and softmax are trained jointly (Adagrad). A passage that n texts hold weighs sqrt(n), 10 at most.

The model is trained on at most ``max_labelled`` labelled texts of at most ``max_total`` bytes together, the first in hash order;
everything else covers all rows. The halves are trained in two tasks at a time and the last model in one, so the driver holds
only the bounded sample and the models' tables.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm.words import text_of
from parchmill.session import materialize

CLASSES = ("none", "abuse", "hate", "sexual")
#: Letters of other scripts that look like Latin ones, after lower-casing.
LOOKALIKES = str.maketrans(
    "авекмнорстухіјѕԁһԛԝѵᴏαβεικνορτυχγω",
    "abekmhopctyxijsdhqwvoabeikvoptuxyw",
)
_ZERO_WIDTH = re.compile("[­​-‏⁠﻿]")
_MARKS = re.compile("[̀-ͯ]")
#: A tag of any length if it is made of attributes with values, else whatever stands between < and > on up to 200 characters.
_TAG = re.compile(r"""<[^<>]{0,200}>|<[/!?]?[a-zA-Z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))*\s*/?>""")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_]){3,}[^\W\d_](?![^\W_])")
_LEET = re.compile(r"(?<![^\W_])(?=[a-z]*[013457@$])(?=[013457@$]*[a-z])[a-z013457@$]{4,}(?![^\W_])")
_LEET_OF = str.maketrans("013457@$", "oieastas")


def _unleet(m: re.Match) -> str:
    """Digits for letters, in words of fewer digits than letters."""
    word = m[0]
    return word.translate(_LEET_OF) if 2 * sum(c.isalpha() for c in word) > len(word) else word


_REPEATED = re.compile(r"([^\W\d_])\1{2,}")
_END = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+|\n+")
_TOKEN = re.compile(r"[^\W\d_*]+(?:[*'’]+[^\W\d_*]+)*[*]*|\d+|[*]+[^\W\d_*]+")
BRIEF, LONG, WINDOW, STEP = 3, 14, 8, 4


def undisguised(text: str) -> str:
    if not text.isascii():
        text = _ZERO_WIDTH.sub("", unicodedata.normalize("NFKC", text)).lower().translate(LOOKALIKES)
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    else:
        text = text.lower()
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m[0]), text)
    return _REPEATED.sub(r"\1", _LEET.sub(_unleet, text))


def passages(text: str) -> list[str]:
    """Passages as words separated by single spaces; numbers become 0. A closing sentence of few words is one by itself."""
    out, brief = [], []
    text = undisguised(text)
    for sentence in _END.split(_TAG.sub("\n", text) if "<" in text else text):
        tokens = brief + ["0" if t[0].isdigit() else t for t in _TOKEN.findall(sentence)]
        brief = []
        if len(tokens) < BRIEF:
            brief = tokens  # too little to judge by itself, goes with what follows
        elif len(tokens) <= LONG:
            out.append(" ".join(tokens))
        else:
            starts = [*range(0, len(tokens) - WINDOW, STEP), len(tokens) - WINDOW]
            out += [" ".join(tokens[s : s + WINDOW]) for s in starts]
    if brief:
        out.append(" ".join(brief))
    return out


_A = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, salt: int, size: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int32) % size


def bags(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, passage number) of all passages: hashed character n-grams of 3 to 5, words and word pairs."""
    if not texts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    code = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) + 2 for t in texts])
    of = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    features, numbers = [], []
    h = code * _A
    for n in range(2, 6):
        h = (h[:-1] + code[n - 1 :]) * _A
        if n >= 3:
            inside = of[: len(h)] == of[n - 1 :]
            features.append(_mix(h[inside], n, size))
            numbers.append(of[: len(h)][inside])
    # Hashes of words from prefix sums of code * A^i, all modulo 2^64.
    i = np.flatnonzero(code == 32)
    starts, ends = i[:-1] + 1, i[1:]
    real = (ends > starts) & (of[starts] == of[ends])
    starts, ends = starts[real], ends[real]
    longest = int((ends - starts).max()) if len(starts) else 0
    word = np.zeros(len(starts), np.uint64)
    for k in range(longest):
        has = ends - starts > k
        word[has] = (word[has] + code[starts[has] + k]) * _A
    features.append(_mix(word, 1, size))
    numbers.append(of[starts])
    pair = of[starts[:-1]] == of[starts[1:]]
    features.append(_mix(word[:-1][pair] * np.uint64(31) + word[1:][pair], 2, size))
    numbers.append(of[starts[:-1]][pair])
    return np.concatenate(features), np.concatenate(numbers)


def _features(texts: list[str], size: int, characters: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, one passage after another; their number in each), made from about ``characters`` at a time."""
    parts, counts, begin, held = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= characters or i == len(texts) - 1:
            feature, number = bags(texts[begin : i + 1], size)
            parts.append(feature[np.argsort(number, kind="stable")])
            counts.append(np.bincount(number, minlength=i + 1 - begin))
            begin, held = i + 1, 0
    return np.concatenate(parts), np.concatenate(counts)


class Model:
    """Embeddings (size x dim) and softmax weights (dim x classes)."""

    def __init__(self, size: int = 1 << 19, dim: int = 16, seed: int = 408):
        g = np.random.default_rng(seed)
        self.size, self.dim = size, dim
        self.e = (g.standard_normal((size, dim)) / dim).astype(np.float32)
        self.w = (g.standard_normal((dim, len(CLASSES))) / dim).astype(np.float32)
        self.b = np.zeros(len(CLASSES), np.float32)
        self.thresholds = dict.fromkeys(CLASSES[1:], 0.6)
        self.shares: np.ndarray | None = None

    def table(self) -> np.ndarray:
        """Each feature's share in the scores; with the bias, all that scoring needs."""
        return self.shares if self.shares is not None else (self.e @ self.w).astype(np.float32)

    @classmethod
    def averaged(cls, fitted: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        """A model with the mean scores of (table, bias) pairs: scores are linear in the tables, so these are averaged."""
        out = object.__new__(cls)
        out.shares = np.mean([t for t, _ in fitted], axis=0, dtype=np.float32)
        out.b = np.mean([b for _, b in fitted], axis=0)
        return out

    def fit(self, texts: list[str], target: np.ndarray, weight: np.ndarray, epochs: int = 4, updates: int = 2000, rate: float = 0.5, batch: int = 64, seed: int = 1) -> None:
        feature, n = _features(texts, self.size)
        first = np.concatenate([[0], np.cumsum(n)])
        ge, gw, gb = np.full(self.size, 1e-4, np.float32), np.full_like(self.w, 1e-4), np.full_like(self.b, 1e-4)
        g = np.random.default_rng(seed)
        usable = np.flatnonzero(n > 0)
        for _ in range(max(epochs, -(-updates * batch // max(1, len(usable))))):
            g.shuffle(usable)
            for s in range(0, len(usable), batch):
                rows = usable[s : s + batch]
                sizes = n[rows]
                ends = np.cumsum(sizes)
                at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(first[rows], sizes)
                f = feature[at]
                x = np.add.reduceat(self.e[f], ends - sizes, axis=0) / sizes[:, None]
                z = x @ self.w + self.b
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = z / z.sum(axis=1, keepdims=True)
                d[np.arange(len(rows)), target[rows]] -= 1
                d *= weight[rows][:, None] / len(rows)
                dw, db = x.T @ d, d.sum(axis=0)
                dx = np.repeat((d @ self.w.T / sizes[:, None]).astype(np.float32), sizes, axis=0)
                o = np.argsort(f, kind="stable")
                fs = f[o]
                new = np.flatnonzero(np.diff(fs, prepend=-1))
                de, ids = np.add.reduceat(dx[o], new, axis=0), fs[new]
                gw += dw**2
                gb += db**2
                ge[ids] += (de**2).mean(axis=1)
                self.w -= rate * dw / np.sqrt(gw)
                self.b -= rate * db / np.sqrt(gb)
                self.e[ids] -= rate * de / np.sqrt(ge[ids])[:, None]


def probabilities(table: np.ndarray, bias: np.ndarray, texts: list[str]) -> np.ndarray:
    feature, number = bags(texts, len(table))
    n = np.maximum(np.bincount(number, minlength=len(texts)), 1)
    z = np.stack([np.bincount(number, table[feature, c], minlength=len(texts)) / n + bias[c] for c in range(table.shape[1])], axis=1)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _fit(texts: list[str], job: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, bias, probabilities of the passages to judge) of a model fitted to some of the passages."""
    m, rows = Model(**job["model"]), job["rows"]
    m.fit([texts[i] for i in rows], job["target"][rows], job["weight"][rows], job["epochs"], job["updates"])
    return m.table(), m.b, probabilities(m.table(), m.b, [texts[i] for i in job["judge"]])


def _here(texts: list[str], jobs: list[dict]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [_fit(texts, j) for j in jobs]


def _in_tasks(spark: SparkSession):
    """Fits each job in a task of its own; what goes there and comes back is bounded by the sample and the table."""

    def run(texts: list[str], jobs: list[dict]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b["id"].to_pylist():
                    parts = [np.asarray(x, np.float32).ravel() for x in _fit(texts, jobs[k])]
                    yield pa.RecordBatch.from_arrays([pa.array([k]), *[pa.array([x], pa.list_(pa.float32())) for x in parts]], ["id", "share", "bias", "judged"])

        out: list = [None] * len(jobs)
        for r in spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(fit, "id long, share array<float>, bias array<float>, judged array<float>").toArrow().to_batches():
            for i in range(len(r)):
                out[r["id"][i].as_py()] = tuple(r[c][i].values.to_numpy().astype(np.float32 if c == "share" else np.float64) for c in ("share", "bias", "judged"))
        return [(t.reshape(-1, len(CLASSES)), b, q.reshape(-1, len(CLASSES))) for t, b, q in out]

    return run


def train(labelled: list[tuple[str, str]], rounds: int = 2, epochs: int = 4, updates: int = 800, final_epochs: int = 10, honest: float = 0.75, trust: float = 0.2, least: float = 0.6, allowed: float = 0.005, run=_here, **model) -> Model:
    """A model from (text, majority label) pairs; ``rounds`` of relabelling by models trained on the other half of the texts.

    ``thresholds`` of the model: for each category ``least``, or as much as leaves at most a share of ``allowed`` of the
    texts labelled none above it, by the models that haven't seen them; with few labels the models are less sure. ``run`` fits
    the models of a round, here or in tasks.
    """
    texts, place, given, harmless = [], {}, [], []
    for k, (text, label) in enumerate(labelled):
        own = dict.fromkeys(passages(text))
        for p in own:
            if p not in place:
                place[p] = len(texts)
                texts.append(p)
                given.append(np.zeros((2, len(CLASSES)), np.int64))
            given[place[p]][k % 2, CLASSES.index(label)] += 1
        if label == "none" and own:
            harmless.append((k % 2, [place[p] for p in own]))
    halves = np.array(given, np.int64).reshape(-1, 2, len(CLASSES))
    counts, inside = halves.sum(axis=1), halves.sum(axis=2) > 0
    flagged = counts[:, 1:].sum(axis=1)
    majority = lambda c: np.where(c[:, 1:].sum(axis=1) > c[:, 0], c[:, 1:].argmax(axis=1) + 1, 0)
    targets = [majority(halves[:, h]) for h in (0, 1)]
    # says[c, l]: how often a text with a passage of class c is labelled l; a text with a harmless one is like any text.
    shares = (counts.sum(axis=0) + 1) / (counts.sum() + len(CLASSES))
    says = np.full((len(CLASSES), len(CLASSES)), (1 - honest) / (len(CLASSES) - 1))
    np.fill_diagonal(says, honest)
    says[0] = shares

    weight = np.minimum(np.sqrt(counts.sum(axis=1)), 10).astype(np.float32)
    nobody = np.zeros(0, np.int64)

    def job(rows: np.ndarray, target: np.ndarray, n: int, judge: np.ndarray) -> dict:
        return {"rows": rows, "target": target, "weight": weight, "epochs": n, "updates": updates, "judge": judge, "model": model}

    target, worst, judging = targets[0], np.zeros((0, len(CLASSES))), []
    for k in range(rounds):
        p, judges = np.zeros((len(texts), len(CLASSES))), np.zeros(len(texts))
        worst = np.zeros((len(harmless), len(CLASSES)))
        jobs = [job(np.flatnonzero(inside[:, h]), targets[h], final_epochs if k == rounds - 1 else epochs, np.flatnonzero(inside[:, 1 - h])) for h in (0, 1)]
        judging = run(texts, jobs)
        for h in (0, 1):
            judged = jobs[h]["judge"]
            q = np.zeros((len(texts), len(CLASSES)))
            q[judged] = judging[h][2]
            p, judges[judged] = p + q, judges[judged] + 1
            for j, (half, ids) in enumerate(harmless):
                if half != h:
                    worst[j] = q[ids].max(axis=0)
        p = np.clip(p / np.maximum(judges, 1)[:, None], 0.02, 0.98)
        # What the labels of all texts that hold the passage say, were it of each class; tempered, as a label may be given
        # for another passage of the text.
        posterior = np.log(p) + trust * (counts @ np.log(says).T)
        target = posterior.argmax(axis=1)
        targets = [target, target]
    last = run(texts, [job(np.arange(len(texts)), target, final_epochs, nobody)])
    m = Model.averaged([x[:2] for x in last + judging])
    m.thresholds = {c: float(np.clip(np.quantile(worst[:, i], 1 - allowed), least, 0.99)) if len(worst) else least for i, c in enumerate(CLASSES) if i}
    return m


def _scorer(table: np.ndarray, bias: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, count = np.zeros((len(b), len(CLASSES)), np.float64), np.zeros(len(b), np.int64)
            # Each distinct passage is judged once; the texts that hold it are kept as numbers.
            held, owner, which, size = {}, [], [], 0

            def judge() -> None:
                if held:
                    p = probabilities(table, bias, list(held))
                    np.maximum.at(best, np.array(owner), np.where(np.arange(len(CLASSES)) == 0, 0, p[np.array(which)]))

            for i, t in enumerate(b["_text"].cast(pa.binary()).to_pylist()):
                for passage in passages(text_of(t)):
                    if passage not in held:
                        size += len(passage)
                    which.append(held.setdefault(passage, len(held)))
                    owner.append(i)
                    count[i] += 1
                    if size > 1 << 21 or len(which) > 1 << 20:
                        judge()
                        held, owner, which, size = {}, [], [], 0
            judge()
            yield pa.RecordBatch.from_arrays([b["_key"], pa.array(count), *[pa.array(best[:, c]) for c in range(1, len(CLASSES))]], ["_key", "passages", *CLASSES[1:]])

    return run


def majority(labels: DataFrame, key: str, annotator: str, category: str) -> DataFrame:
    """(key, label) of the records whose annotators' judgements have a single most frequent category.

    Repeated rows count once; null keys, null categories and ones that aren't known are left out, as are records on which
    as many annotators say one thing as another.
    """
    votes = labels.where(F.col(category).isin(*CLASSES) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(annotator).alias("_by"), F.col(category).alias("_category")).distinct()
    counts = votes.groupBy("_key", "_category").agg(F.count("*").alias("n"))
    top = counts.groupBy("_key").agg(F.max(F.struct("n", "_category")).alias("most"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    return top.where("size(ns) = 1 OR ns[0] > ns[1]").select(F.col("_key").alias(key), F.col("most._category").alias("label"))


def train_on(texts: DataFrame, key: str, text: str, labels: DataFrame, annotator: str = "annotator", category: str = "category", max_labelled: int = 20_000, max_bytes: int = 50_000, max_total: int = 24 << 20) -> Model:
    """A model from the labelled texts: at most ``max_labelled`` of at most ``max_bytes`` each and ``max_total`` together go to the driver.

    Training runs in tasks (``_in_tasks``).
    """
    judged = majority(labels, key, annotator, category)
    of = texts.select(F.col(key), F.col(text).alias("_text")).where((F.octet_length("_text") > 0) & (F.octet_length("_text") <= max_bytes)).join(judged, key)
    sample = of.groupBy(key).agg(F.max(F.struct("_text", "label")).alias("r")).orderBy(F.xxhash64(key), key).limit(max_labelled)
    held, size = [], 0
    for r in materialize(sample, "sample").orderBy(F.xxhash64(key), key).toLocalIterator():
        size += len(r["r"]["_text"].encode())
        if size > max_total:
            break
        held.append((r["r"]["_text"], r["r"]["label"]))
    return train(held, run=_in_tasks(texts.sparkSession))


def score(texts: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, passages, abuse, hate, sexual): for each row of ``texts`` the greatest probability any of its passages has.

    Null, empty and wordless texts have no passages and scores of 0. Texts are scored whole, of any length. Rows of a
    repeated key are scored each. Other columns are ignored; an empty table gives no rows.
    """
    rows = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    out = rows.mapInArrow(_scorer(model.table(), model.b), f"_key {kind}, passages long, " + ", ".join(f"{c} double" for c in CLASSES[1:]))
    return out.withColumnRenamed("_key", key)


def categories(scores: DataFrame, key: str, thresholds: dict[str, float]) -> DataFrame:
    """(key, category): a row for each category that some passage is of with at least its threshold."""
    named = F.array_compact(F.array(*[F.when(F.col(c) >= thresholds[c], F.lit(c)) for c in CLASSES[1:]]))
    return scores.select(key, F.explode(named).alias("category")).distinct()
