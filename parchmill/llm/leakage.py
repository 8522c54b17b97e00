"""Evaluation texts leaking into training text, by latent semantic retrieval.

The words of the evaluation items are the vocabulary: no passage without them can leak. Texts become sequences of word
codes (-1: not in the vocabulary); those without enough vocabulary words for any item are dropped. Passages are windows of 15
words, one every 4, so every run of 12 words lies within one. Their TF-IDF matrix, with document frequencies over all
passages, is factored by a distributed randomised SVD: tasks add up their part of A'AX, terms by rank, and the driver only
orthogonalises a matrix of vocabulary by rank. Items are cut into queries of 9 words, one every 4 (a run of 12 holds one).
The queries' latent vectors stand in an inverted file: lists around spherical centres. A passage is compared by cosine with the
queries of the lists whose centres are nearest to it. A passage near a query of an item makes the
text a candidate for the item; candidates are then decided on the words themselves:

* verbatim: 12 words of the item in a row (all of them if it has fewer) are in the text in a row; items of fewer than 12 words
  are also looked up in all texts directly;
* paraphrase: the longest common subsequence of item and region holds at least ``lcs_share`` of the item's words, and the
  region holds the item's answer, its rarest words.

Which passages are compared with an item depends on that item alone: where only verbatim leaks are asked for, those with as
many vocabulary words as its run; for paraphrases, those with as many as the richest passage of a region that reaches
``lcs_share`` must have (``paraphrase_gate``).

The items are a stated query set and are compared with all rows. The texts are read, coded and factored once for a group of
items, which ends at ``vocabulary`` distinct words or ``group_bytes`` of text (a million short items are a few groups), and the
coded texts are searched once for each block of at most ``block`` queries of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.words import text_of, words
from parchmill.session import materialize

RUN, WIDTH, STEP, QUERY, QUERY_STEP = 12, 15, 4, 9, 4
RANK, SPARE = 128, 16


def _windows(n: int, width: int, step: int) -> list[tuple[int, int]]:
    """Stretches of ``width``, one every ``step``, such that every stretch of width - step + 1 lies within one."""
    if n <= width:
        return [(0, n)]
    return [(s, min(s + width, n)) for s in range(0, n - width + step, step)]


def paraphrase_gate(n: int, lcs_share: float) -> int:
    """Words of an item of ``n`` words that the richest passage holds in any region with ``lcs_share`` of them.

    Every word lies in three passages at least, and no more passages than this touch a region of the greatest length.
    """
    region = n * 3 // 2 // 4 + max(WIDTH, n * 3 // 2)
    return max(1, -(-3 * int(np.ceil(lcs_share * n)) // ((region + WIDTH) // STEP + 1)))


class Items:
    """Evaluation items: word codes in a vocabulary (their own unless given), queries, least vocabulary words of a passage."""

    def __init__(self, rows: list[tuple], paraphrases: bool = True, lcs_share: float = 0.7, vocabulary: dict[str, int] | None = None):
        found = [(key, words(text or "")) for key, text in rows]
        found = [(key, w) for key, w in found if w]
        self.keys = [key for key, _ in found]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in found for w in ws}))} if vocabulary is None else vocabulary
        self.codes = [np.array([self.vocabulary[w] for w in ws], np.int32) for _, ws in found]
        self.paraphrases = paraphrases
        self.run_size = [min(RUN, len(c)) for c in self.codes]
        self.gate = np.array([min(r, paraphrase_gate(len(c), lcs_share)) if paraphrases else r for c, r in zip(self.codes, self.run_size)], np.int64)
        #: A passage with fewer vocabulary words can't be compared with any item.
        self.need = int(self.gate.min()) if len(self.gate) else 1
        #: The runs of an item of which one must be in a text.
        self.runs = [{c[s : s + RUN].tobytes() for s in range(max(1, len(c) - RUN + 1))} for c in self.codes]
        self.queries, self.query_item = [], []
        for i, c in enumerate(self.codes):
            cuts = [(0, len(c))] if len(c) < RUN else _windows(len(c), QUERY, QUERY_STEP)
            self.queries += [c[a:b] for a, b in cuts]
            self.query_item += [i] * len(cuts)
        self.query_item = np.array(self.query_item, np.int64)

    def part(self, of: range) -> Items:
        """Some of the items, in the same vocabulary."""
        out = object.__new__(Items)
        out.vocabulary, out.paraphrases = self.vocabulary, self.paraphrases
        for name in ("keys", "codes", "run_size", "runs"):
            setattr(out, name, getattr(self, name)[of.start : of.stop])
        out.gate = self.gate[of.start : of.stop]
        at = np.flatnonzero((self.query_item >= of.start) & (self.query_item < of.stop))
        out.queries, out.query_item, out.need = [self.queries[k] for k in at], self.query_item[at] - of.start, self.need
        return out

    def blocks(self, queries: int) -> list[Items]:
        """Consecutive items with about ``queries`` queries each, at least one item."""
        each, ends, size = np.bincount(self.query_item, minlength=len(self.keys)), [0], 0
        for i, n in enumerate(each.tolist()):
            if size and size + n > queries:
                ends.append(i)
                size = 0
            size += n
        return [self.part(range(x, y)) for x, y in zip(ends, [*ends[1:], len(self.keys)])]


def _passages(codes: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, passages x WIDTH codes, -1 beyond the end) of a text's passages with at least ``need`` vocabulary words."""
    last = max(0, -(-(len(codes) - WIDTH) // STEP)) * STEP if len(codes) > WIDTH else 0
    starts = np.arange(0, last + 1, STEP)
    padded = np.full(last + WIDTH, -1, np.int32)
    padded[: len(codes)] = codes
    known = np.concatenate([[0], np.cumsum(padded >= 0)])
    starts = starts[known[starts + WIDTH] - known[starts] >= need]
    return starts, padded[starts[:, None] + np.arange(WIDTH)]


def _coder(vocabulary: dict[str, int], need: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, codes = [], []
            for i, t in enumerate(b["_text"].cast(pa.binary()).to_pylist()):
                c = np.array([vocabulary.get(w, -1) for w in words(text_of(t))], np.int32)
                if len(c) and len(_passages(c, need)[0]):
                    at.append(i)
                    codes.append(c)
            if at:
                yield pa.RecordBatch.from_arrays([b["_key"].take(pa.array(at)), pa.array(codes, pa.list_(pa.int32()))], ["_key", "codes"])

    return run


def _block(codes: list[np.ndarray], width: int = WIDTH) -> np.ndarray:
    """Code sequences as rows of one width, filled up with -1."""
    out = np.full((len(codes), max([width, *map(len, codes)])), -1, np.int32)
    for i, c in enumerate(codes):
        out[i, : len(c)] = c
    return out


def _same(block: np.ndarray) -> np.ndarray:
    return (block[:, :, None] == block[:, None, :]) & (block >= 0)[:, :, None]


def _weights(block: np.ndarray, idf: np.ndarray, unit: bool) -> np.ndarray:
    """The TF-IDF weight of each place, so that a row's vector is the sum of its places; of unit length, or as it is."""
    w = np.where(block >= 0, idf[block], 0).astype(np.float32)
    if unit:
        # A term's places add up: |row|^2 is the sum over all pairs of places with the same term.
        norm = np.sqrt((_same(block) * (w * w)[:, :, None]).sum(axis=(1, 2)))
        w /= np.maximum(norm, 1e-9)[:, None]
    return w


def _project(block: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows times ``x`` (terms x rank), gathering a row of ``x`` per place."""
    out = np.zeros((len(block), x.shape[1]), np.float32)
    for k in range(block.shape[1]):
        out += w[:, k, None] * x[block[:, k]]
    return out


def _spread(block: np.ndarray, w: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """The transposed rows times ``y``: terms x rank."""
    row, place = np.nonzero(block >= 0)
    code = block[row, place]
    order = np.argsort(code, kind="stable")
    code, row, value = code[order], row[order], w[row, place][order]
    out = np.zeros((size, y.shape[1]), np.float64)
    if len(code):
        first = np.flatnonzero(np.diff(code, prepend=-1))
        out[code[first]] = np.add.reduceat(value[:, None] * y[row], first, axis=0)
    return out


def _document_frequency(block: np.ndarray, size: int) -> np.ndarray:
    earlier = np.tril(np.ones((block.shape[1],) * 2, bool), -1)
    new = (block >= 0) & ~(_same(block) & earlier).any(axis=2)
    return np.bincount(block[new], minlength=size)


def _chunks(batches: Iterator[pa.RecordBatch], need: int, rows: int):
    """Passages of all texts, about ``rows`` at a time: (block, text numbers, starts, texts), never across batches."""
    for b in batches:
        texts = [np.asarray(c, np.int32) for c in b["codes"].to_numpy(zero_copy_only=False)]
        held: list[tuple] = []
        size = 0
        for i, c in enumerate(texts):
            starts, block = _passages(c, need)
            for s in range(0, len(starts), rows):
                held.append((block[s : s + rows], np.full(len(starts[s : s + rows]), i), starts[s : s + rows]))
                size += len(held[-1][2])
                if size >= rows:
                    yield *map(np.concatenate, zip(*held)), texts
                    held, size = [], 0
        if held:
            yield *map(np.concatenate, zip(*held)), texts


def _frequency(size: int, need: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        for block, _, _, _ in _chunks(batches, need, rows):
            df += _document_frequency(block, size)
            n += len(block)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1]), pa.array([*df[at].tolist(), n])], ["term", "n"])

    return run


def _gram(x: np.ndarray, idf: np.ndarray, need: int, rows: int):
    """This task's part of A'A x, a row per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(x.shape, np.float64)
        for block, _, _, _ in _chunks(batches, need, rows):
            w = _weights(block, idf, unit=True)
            out += _spread(block, w, _project(block, w, x), len(idf))
        at = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(out[at, j]) for j in range(x.shape[1])]], ["term", *[f"y{j}" for j in range(x.shape[1])]])

    return run


def latent_space(texts: DataFrame, items: Items, rank: int = RANK, seed: int = 408, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(idf, terms x rank basis) of the passages of ``texts`` and the queries of ``items``, by randomised SVD with one power step.

    What comes to the driver is vocabulary by rank, whatever the number of texts.
    """
    size = len(items.vocabulary)
    df = np.zeros(size, np.int64)
    total = 0
    for r in texts.mapInArrow(_frequency(size, items.need, rows), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["term"] < 0:
            total = r["n"]
        else:
            df[r["term"]] = r["n"]
    own = [_block(items.queries[k : k + 8192]) for k in range(0, len(items.queries), 8192)]
    df, total = df + sum(_document_frequency(o, size) for o in own), total + len(items.queries)
    idf = (1 + np.log((1 + total) / (1 + df))).astype(np.float32)
    w = [_weights(o, idf, unit=True) for o in own]
    width = min(size, rank + SPARE)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0].astype(np.float32)
    for last in (False, True):
        y = sum(_spread(o, v, _project(o, v, x), size) for o, v in zip(own, w))
        sums = texts.mapInArrow(_gram(x, idf, items.need, rows), "term long, " + ", ".join(f"y{j} double" for j in range(width)))
        for r in sums.groupBy("term").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(width)]).toLocalIterator():
            y[r["term"]] += [r[f"y{j}"] for j in range(width)]
        if last:  # the eigenvectors of A'A within the span of x
            t = x.T.astype(np.float64) @ y
            vectors = np.linalg.eigh((t + t.T) / 2)[1][:, ::-1][:, : min(rank, width)]
            return idf, (x @ vectors).astype(np.float32)
        x = np.linalg.qr(y)[0].astype(np.float32)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; code -1 matches nothing. One pass over ``b``, its rows as bits of an integer."""
    at: dict[int, int] = {}
    for i, c in enumerate(a.tolist()):
        if c >= 0:
            at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b.tolist():
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def inverted_file(q: np.ndarray, per_list: int = 32, rounds: int = 6, seed: int = 408) -> tuple[np.ndarray, list[np.ndarray]]:
    """(centres, rows of ``q`` of each list): unit vectors around spherical k-means centres, about ``per_list`` to a list."""
    k = max(1, len(q) // per_list)
    centres = q[np.random.default_rng(seed).permutation(len(q))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([(q[s : s + 4096] @ centres.T).argmax(axis=1) for s in range(0, len(q), 4096)])
        for c in range(k):
            if (near == c).any():
                centres[c] = q[near == c].sum(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    near = np.concatenate([(q[s : s + 4096] @ centres.T).argmax(axis=1) for s in range(0, len(q), 4096)])
    lists = [np.flatnonzero(near == c) for c in range(k)]
    full = [c for c in range(k) if len(lists[c])]
    return centres[full], [lists[c] for c in full]


class Index:
    """The queries of some items in the latent space."""

    def __init__(self, items: Items, idf: np.ndarray, basis: np.ndarray, near: float, least: float, held: float, probes: int):
        own = _block(items.queries)
        self.item, self.gate, self.near, self.least, self.held, self.probes = items.query_item, items.gate[items.query_item], near, least, held, probes
        q = _project(own, _weights(own, idf, unit=False), basis)
        self.length = np.maximum(np.linalg.norm(q, axis=1), 1e-9)
        self.q = q / self.length[:, None]
        #: Items of fewer than RUN words may stand among many other words, so their length along the query alone counts.
        self.brief = np.array([n < RUN for n in items.run_size], bool)[self.item]
        self.long = np.flatnonzero(~self.brief)
        self.short = np.flatnonzero(self.brief)
        self.centres, self.lists = inverted_file(self.q[self.long]) if len(self.long) else (np.zeros((0, q.shape[1]), np.float32), [])

    def hits(self, x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``x``, queries) that are near each other; ``known``: vocabulary words of each row."""
        norm = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        rows, queries = [], []

        def compare(r: np.ndarray, of: np.ndarray) -> None:
            along = x[r] @ self.q[of].T
            cosine = along / norm[r]
            kept = along >= self.held * self.length[of]
            hit = np.where(self.brief[of], kept, (cosine >= self.near) | (kept & (cosine >= self.least))) & (known[r][:, None] >= self.gate[of])
            i, k = np.nonzero(hit)
            rows.append(r[i])
            queries.append(of[k])

        if len(self.short):
            compare(np.flatnonzero(known >= self.gate[self.short].min()), self.short)
        enough = np.flatnonzero(known >= self.gate[self.long].min()) if len(self.long) else np.zeros(0, np.int64)
        if len(enough):
            if len(self.lists) <= self.probes:
                compare(enough, self.long)
            else:
                nearest = np.argpartition(-(x[enough] @ self.centres.T), self.probes - 1, axis=1)[:, : self.probes]
                order = np.argsort(nearest, axis=None, kind="stable")
                ends = np.searchsorted(nearest.ravel()[order], np.arange(len(self.lists) + 1))
                for c, of in enumerate(self.lists):
                    if ends[c] < ends[c + 1]:
                        compare(enough[order[ends[c] : ends[c + 1]] // self.probes], self.long[of])
        return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(queries or [np.zeros(0, np.int64)])


def _search(items: Items, idf: np.ndarray, basis: np.ndarray, near: float, least: float, held: float, lcs_share: float, answer_words: int, rows: int, probes: int):
    index = Index(items, idf, basis, near, least, held, probes)
    # Items of fewer than RUN words are also looked up as they are: among other words their cosine may be small.
    short: dict[int, dict[bytes, list[int]]] = {}
    begins = np.zeros(len(idf) + 1, bool)  # the last place is for code -1
    for i, c in enumerate(items.codes):
        if len(c) < RUN:
            short.setdefault(len(c), {}).setdefault(c.tobytes(), []).append(i)
            begins[c[0]] = True
    answers = [set(c[np.argsort(-idf[c], kind="stable")][:answer_words].tolist()) for c in items.codes]

    def decide(codes: np.ndarray, item: int, starts: list[int]) -> tuple[str, float] | None:
        size, runs = items.run_size[item], items.runs[item]
        for s in starts:
            part = codes[s : s + WIDTH]
            if any(part[k : k + size].tobytes() in runs for k in range(len(part) - size + 1)):
                return "verbatim", 1.0
        if not items.paraphrases:
            return None
        reach = len(items.codes[item]) * 3 // 2
        best = 0.0
        last = -1
        for s in starts:
            if s < last:
                continue
            last = s + max(WIDTH, reach // 2)
            region = codes[max(0, s - reach // 4) : s + max(WIDTH, reach)]
            share = lcs(items.codes[item], region) / len(items.codes[item])
            if share >= lcs_share and answers[item] <= set(region.tolist()):
                best = max(best, share)
        return ("paraphrase", best) if best else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            candidates: dict[tuple[int, int], list[int]] = {}
            texts = []
            for block, number, starts, texts in _chunks(iter([b]), items.need, rows):
                p, k = index.hits(_project(block, _weights(block, idf, unit=False), basis), (block >= 0).sum(axis=1))
                for i, item, at in np.unique(np.stack([number[p], items.query_item[k], starts[p]], axis=1), axis=0).tolist():
                    candidates.setdefault((i, item), []).append(at)
            exact = {(i, item) for i, c in enumerate(texts) for s in np.flatnonzero(begins[c]).tolist() for n, of in short.items() for item in of.get(c[s : s + n].tobytes(), ())} if short else set()
            found = [(*pair, "verbatim", 1.0) for pair in exact]
            found += [(i, item, *d) for (i, item), at in candidates.items() if (i, item) not in exact and (d := decide(texts[i], item, at))]
            if found:
                i, item, how, share = zip(*found)
                yield pa.RecordBatch.from_arrays([b["_key"].take(pa.array(i)), pa.array([items.keys[k] for k in item]), pa.array(how), pa.array(share)], ["_key", "_item", "how", "share"])

    return run


def _groups(items: DataFrame, paraphrases: bool, lcs_share: float, vocabulary: int, group_bytes: int) -> Iterator[Items]:
    """The items in order of their keys, as groups of bounded vocabulary and size (or of a single item)."""
    held: list[tuple] = []
    known: set[str] = set()
    size = 0
    for r in items.orderBy("_item", "_text").toLocalIterator():
        own = set(words(r["_text"]))
        if held and (len(known | own) > vocabulary or size + len(r["_text"]) > group_bytes):
            yield Items(held, paraphrases, lcs_share)
            held, known, size = [], set(), 0
        held.append((r["_item"], r["_text"]))
        known |= own
        size += len(r["_text"])
    yield Items(held, paraphrases, lcs_share)


def leaks(texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, near: float = 0.6, least: float = 0.3, held: float = 0.75, lcs_share: float = 0.7, answer_words: int = 3, vocabulary: int = 1 << 16, group_bytes: int = 32 << 20, block: int = 16384, rows: int = 2048, probes: int = 8, paraphrases: bool = True) -> DataFrame:
    """(key, item key, how: verbatim or paraphrase, share of the item's words in order), a row per text and item leaked.

    Words are those of ``words.words``. Null, empty and wordless texts and items leak nothing; a repeated text is reported
    for each of its keys, rows of a repeated key once. Texts may be of any length. A passage is a candidate from a cosine of
    ``near`` on, or of ``least`` if its part along the query is ``held`` of the query's length or more (a passage that holds
    all words of the query has its whole length, however much else is in it). ``probes`` lists of the index are looked up for a
    passage; where there are no more, all queries are. Without ``paraphrases`` only verbatim leaks are
    looked for, which needs fewer comparisons. Other columns are ignored; no texts or no items give no rows.
    """
    source = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind, item_kind = source.schema["_key"].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    stated = items.select(F.col(item_key).alias("_item"), F.col(item_text).alias("_text")).where("_item IS NOT NULL AND _text IS NOT NULL").distinct()
    out = None
    for group in _groups(stated, paraphrases, lcs_share, vocabulary, group_bytes):
        if not group.keys:
            continue
        coded = materialize(source.mapInArrow(_coder(group.vocabulary, group.need), f"_key {kind}, codes array<int>"), "codes")
        idf, basis = latent_space(coded, group, rows=rows)
        for own in group.blocks(block):
            found = coded.mapInArrow(_search(own, idf, basis, near, least, held, lcs_share, answer_words, rows, probes), f"_key {kind}, _item {item_kind}, how string, share double")
            out = found if out is None else out.unionAll(found)
    if out is None:
        out = source.sparkSession.createDataFrame([], f"_key {kind}, _item {item_kind}, how string, share double")
    return out.groupBy("_key", "_item").agg(F.max("how").alias("how"), F.max("share").alias("share")).withColumnsRenamed({"_key": key, "_item": item_key})
