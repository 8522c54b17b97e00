"""Filling containers of fixed capacity with texts, by lexical retrieval over a sharded BM25 inverted index.

Every text becomes hashed terms (2^18 of them, so the statistics have a fixed size whatever the corpus). Document counts of
all terms and the mean length come from all texts. Texts are dealt to shards of about ``shard_bytes`` by content, so that a
text's neighbours are likely in its own shard: the BM25 weights of a text, sketched to 128 dimensions, lead to the nearest of 64
centres (spherical k-means on a bounded sample), the centres stand in a chain of neighbours, and the chain is cut by bytes; what
lies around one centre and is too much for a shard is split by hash. Each shard has its own inverted index. The largest unused text seeds a container; BM25 over the index ranks the unused texts
against it, and those that still fit go in, best first; what room is left goes to the largest unused texts that fit, until
none does. A shard leaves at most one container ill-filled, so the loss falls with the size of the shard.
A text larger than a container is cut: its whole containers are full, its rest is packed like a text.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.words import ragged, text_of, words
from parchmill.session import materialize

TERMS = 1 << 18
DIMENSIONS, CENTRES, SLOTS, SAMPLE = 128, 64, 64, 4096
K1, B = 1.2, 0.75


def _features():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, tfs, totals = [], [], []
            for t in b["_text"].cast(pa.binary()).to_pylist():
                counts = Counter(zlib.crc32(w.encode()) % TERMS for w in words(text_of(t)))
                codes.append(list(counts))
                tfs.append(list(counts.values()))
                totals.append(sum(counts.values()))
            yield pa.RecordBatch.from_arrays([b["_key"], b["_n"], pa.array(codes, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32())), pa.array(totals, pa.int64())], ["_key", "_n", "terms", "tf", "words"])

    return run


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(TERMS, np.int64)
    for b in batches:
        df += np.bincount(b["terms"].flatten().to_numpy(), minlength=TERMS)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])


def _weight(term: np.ndarray, tf: np.ndarray, relative_length: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * relative_length))


def sketches(term: np.ndarray, weight: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Unit vectors of DIMENSIONS: every term adds its weight to four places with signs of its own."""
    out = np.zeros(rows * DIMENSIONS)
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93):
        h = ((term.astype(np.uint64) + np.uint64(1)) * np.uint64(salt)) >> np.uint64(40)
        sign = 1.0 - 2.0 * (h & np.uint64(1)).astype(np.float64)
        out += np.bincount(row * DIMENSIONS + ((h >> np.uint64(1)) % np.uint64(DIMENSIONS)).astype(np.int64), weight * sign, minlength=rows * DIMENSIONS)
    out = out.reshape(rows, DIMENSIONS)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def centres_of(v: np.ndarray, k: int, rounds: int = 8, seed: int = 408) -> np.ndarray:
    """At most k unit centres of the rows, each next to the one most like it among those that follow."""
    if not len(v):
        return np.zeros((1, DIMENSIONS))
    c = v[np.random.default_rng(seed).permutation(len(v))[:k]].copy()
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        for j in np.unique(near):
            c[j] = v[near == j].sum(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    left, order = np.ones(len(c), bool), [0]
    left[0] = False
    while left.any():
        order.append(int(np.where(left, c @ c[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return c[order]


def _sketcher(idf: np.ndarray, mean_words: float, centres: np.ndarray | None):
    """The rows' sketches or, with ``centres``, the rows themselves with the nearest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            row = np.repeat(np.arange(len(b)), np.diff(b["terms"].offsets.to_numpy()))
            tf = b["tf"].flatten().to_numpy().astype(np.float64)
            term = b["terms"].flatten().to_numpy()
            v = sketches(term, _weight(term, tf, b["words"].to_numpy()[row] / max(mean_words, 1e-9), idf), row, len(b))
            if centres is None:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.list_(pa.float64()))], ["v"])
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((v @ centres.T).argmax(axis=1).astype(np.int32))], [*b.schema.names, "centre"])

    return run


def shards_of(bytes_of: dict[tuple[int, int], int], shard_bytes: int) -> list[tuple[int, int, int, int]]:
    """(centre, slot, first shard, shards) of cells in order: shards are cut where the next cell would overfill one; a cell too large for one has several."""
    out, shard, room = [], 0, shard_bytes
    for cell, n in sorted(bytes_of.items()):
        if n > room and room < shard_bytes:
            shard, room = shard + 1, shard_bytes
        pieces = max(1, -(-n // shard_bytes))
        out.append((*cell, shard, pieces))
        if pieces > 1:
            shard, room = shard + pieces, shard_bytes
        else:
            room -= n
    return out


def fill(sizes: np.ndarray, ranked, capacity: int) -> list[list[int]]:
    """Containers of items (as places in ``sizes``). ``ranked(i)`` gives the items related to item i, best first."""
    order = np.argsort(sizes, kind="stable")
    by_size = [(int(sizes[i]), int(i)) for i in order]
    used = np.zeros(len(sizes), bool)
    out = []

    def take(i: int) -> None:
        used[i] = True
        by_size.pop(bisect_right(by_size, (int(sizes[i]), i)) - 1)

    while by_size:
        seed = by_size[-1][1]
        take(seed)
        inside, room = [seed], capacity - int(sizes[seed])
        if by_size and by_size[0][0] <= room:
            for i in ranked(seed):
                if not by_size or by_size[0][0] > room:
                    break
                if not used[i] and sizes[i] <= room:
                    take(int(i))
                    inside.append(int(i))
                    room -= int(sizes[i])
        while by_size and by_size[0][0] <= room:
            i = by_size[bisect_right(by_size, (room, len(sizes))) - 1][1]
            take(i)
            inside.append(i)
            room -= int(sizes[i])
        out.append(inside)
    return out


def _packer(capacity: int, idf: np.ndarray, mean_words: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_key").combine_chunks()
        n, shard = group["_n"].to_numpy(), group["shard"][0].as_py()
        lists = group["terms"].combine_chunks() if isinstance(group["terms"], pa.ChunkedArray) else group["terms"]
        tf = group["tf"].combine_chunks().flatten().to_numpy().astype(np.float32)
        term = lists.flatten().to_numpy()
        per = np.diff(lists.offsets.to_numpy())
        first = np.concatenate([[0], np.cumsum(per)])
        doc = np.repeat(np.arange(len(n)), per)
        length = group["words"].to_numpy() / max(mean_words, 1e-9)
        weight = _weight(term, tf, length[doc], idf)
        order = np.argsort(term, kind="stable")
        postings, weights = doc[order], weight[order].astype(np.float64)
        distinct, start = np.unique(term[order], return_index=True)
        end = np.append(start[1:], len(order))
        place = np.searchsorted(distinct, term)

        def ranked(i: int) -> np.ndarray:
            at = place[first[i] : first[i + 1]]
            of = ragged(start[at], end[at] - start[at])
            score = np.bincount(postings[of], weights[of], minlength=len(n))
            near = np.flatnonzero(score > 0)
            return near[np.argsort(-score[near], kind="stable")]

        cut = n > capacity
        whole = np.where(cut, n // capacity, 0)
        rest = np.where(cut, n % capacity, n)
        items = np.flatnonzero(rest > 0)
        back = {int(x): k for k, x in enumerate(items)}
        local = lambda k: (back[int(j)] for j in ranked(int(items[k])) if int(j) in back)
        docs, container, slot, piece, begin, size = [], [], [], [], [], []
        number = 0
        for i in np.flatnonzero(cut):
            for k in range(int(whole[i])):
                docs.append(i), container.append(number), slot.append(0), piece.append(k), begin.append(k * capacity), size.append(capacity)
                number += 1
        for inside in fill(rest[items], local, capacity):
            for s, k in enumerate(inside):
                i = items[k]
                docs.append(i), container.append(number), slot.append(s), piece.append(int(whole[i])), begin.append(int(whole[i]) * capacity), size.append(int(rest[i]))
            number += 1
        at = pa.array(np.array(docs, np.int64))
        pieces = np.where(cut, whole + (rest > 0), 1)
        cols = [pa.array(np.full(len(docs), shard), pa.int64()), pa.array(container, pa.int64()), pa.array(slot, pa.int32()), group["_key"].take(at), pa.array(piece, pa.int32()), pa.array(pieces[np.array(docs, np.int64)], pa.int32()), pa.array(begin, pa.int64()), pa.array(size, pa.int64())]
        return pa.table(cols, ["shard", "container", "slot", "_key", "piece", "pieces", "start", "tokens"])

    return run


def pack(df: DataFrame, key: str, text: str, capacity: int = 8192, shard_bytes: int = 4 << 20) -> DataFrame:
    """(shard, container, slot, key, piece, pieces, start, tokens): where each text, or each piece of a large one, lies.

    Sizes are tokens of the byte-level tokenizer, one per UTF-8 byte. A container is (shard, container); ``start`` counts
    tokens of the text. Only texts above ``capacity`` have several pieces. Null and empty texts take no room and give no
    rows; repeated texts are items of their own; keys are expected to be unique, rows of a repeated or null key count as
    items of their own too. Other columns are ignored, an empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.octet_length(text).cast("long").alias("_n")).where("_n > 0")
    kind = dict(rows.dtypes)["_key"]
    docs = materialize(rows.mapInArrow(_features(), f"_key {kind}, _n long, terms array<int>, tf array<int>, words long"), "features")
    total = docs.agg(F.count("*").alias("docs"), F.sum("_n").alias("bytes"), F.avg("words").alias("words")).first()
    counts = docs.select("terms").mapInArrow(_document_counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    known = np.zeros(TERMS, np.int64)
    for r in counts.toLocalIterator():  # at most TERMS rows
        known[r["term"]] = r["df"]
    idf, mean = np.log1p((total["docs"] - known + 0.5) / (known + 0.5)).astype(np.float32), total["words"] or 0.0
    dealt = deal(docs, idf, mean, shard_bytes)
    run = _packer(capacity, idf, mean)
    out = dealt.groupBy("shard").applyInArrow(run, f"shard long, container long, slot int, _key {kind}, piece int, pieces int, start long, tokens long")
    return out.withColumnRenamed("_key", key)


def deal(docs: DataFrame, idf: np.ndarray, mean: float, shard_bytes: int) -> DataFrame:
    """``docs`` with their shard. The centres are fitted on SAMPLE texts of at most as many distinct terms; to the driver come their sketches and the bytes of CENTRES x SLOTS cells, whatever the corpus."""
    place = F.xxhash64("_key", "_n")
    sample = docs.where(F.size("terms") <= SAMPLE).orderBy(place, "_key").limit(SAMPLE).select("terms", "tf", "words").mapInArrow(_sketcher(idf, mean, None), "v array<double>")
    centres = centres_of(np.array([r["v"] for r in sample.toLocalIterator()]).reshape(-1, DIMENSIONS), CENTRES)
    routed = docs.mapInArrow(_sketcher(idf, mean, centres), ", ".join(f"{n} {t}" for n, t in docs.dtypes) + ", centre int").withColumn("slot", F.pmod(place, F.lit(SLOTS)).cast("int"))
    cells = {(r["centre"], r["slot"]): r["n"] for r in routed.groupBy("centre", "slot").agg(F.sum("_n").alias("n")).toLocalIterator()}
    table = docs.sparkSession.createDataFrame(shards_of(cells, shard_bytes), "centre int, slot int, first long, shards long")
    piece = F.pmod(F.xxhash64(F.lit("piece"), "_key", "_n"), F.col("shards"))
    return routed.join(F.broadcast(table), ["centre", "slot"]).withColumn("shard", F.col("first") + piece).drop("centre", "slot", "first", "shards")  # at most CENTRES x SLOTS rows
