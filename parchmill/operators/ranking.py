"""BM25 of all pages for many queries, without a shuffle of the scores.

The index is written once, in blocks of pages with their postings by word. Each task takes a group of queries and streams the
blocks past it, so neither scores nor postings are exchanged: a task holds a number for each of its queries and pages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.session import materialize

#: Pages of a block; queries of a group whose scores are held, and of one of which only the best are.
BLOCK, HELD, BEST = 16384, 48, 512
_INDEX = "ids binary, lengths binary, words array<string>, starts binary, docs binary, tf binary"


def _blocks(batches):
    """Pages (lop_id, words) packed: ids and lengths, and for each word the pages that hold it and how often."""

    def packed(ids: list, words: list[pa.Array]) -> pa.RecordBatch:
        flat = pa.concat_arrays([w.flatten() for w in words]).dictionary_encode()
        lengths = np.concatenate([w.value_lengths().to_numpy(zero_copy_only=False) for w in words]).astype(np.int64)
        page = np.repeat(np.arange(len(lengths)), lengths)
        key, tf = np.unique(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(lengths) + page, return_counts=True)
        starts = np.searchsorted(key, np.arange(len(flat.dictionary) + 1) * len(lengths))
        row = [[np.concatenate(ids).tobytes()], [lengths.tobytes()], [flat.dictionary.to_pylist()], [starts.astype(np.int64).tobytes()], [(key % len(lengths)).astype(np.int32).tobytes()], [tf.astype(np.int32).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.binary()] * 2 + [pa.list_(pa.string())] + [pa.binary()] * 3)], names=["ids", "lengths", "words", "starts", "docs", "tf"])

    ids, words, n = [], [], 0
    for b in batches:
        for at in range(0, len(b), BLOCK):
            x = b.slice(at, BLOCK)
            if n + len(x) > BLOCK and n:
                yield packed(ids, words)
                ids, words, n = [], [], 0
            ids.append(x["lop_id"].to_numpy(zero_copy_only=False)), words.append(x["words"])
            n += len(x)
    if n:
        yield packed(ids, words)


def _scores(block: dict, group: list, mean: float):
    """(query, ids, scores) of the pages of a block that share a word with a query of the group, itself left out."""
    ids, lengths = (np.frombuffer(block[c], np.int64) for c in ("ids", "lengths"))
    starts, docs, tf = np.frombuffer(block["starts"], np.int64), np.frombuffer(block["docs"], np.int32), np.frombuffer(block["tf"], np.int32)
    part = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[docs] / mean))
    at = {w: i for i, w in enumerate(block["words"])}
    for query, words, weights in group:
        s = np.zeros(len(ids))
        for w, weight in zip(words, weights):
            i = at.get(w)
            if i is not None:
                a, b = starts[i], starts[i + 1]
                s[docs[a:b]] += weight * part[a:b]  # a page stands once with a word
        hit = (s > 0) & (ids != query)
        if hit.any():
            yield query, ids[hit], s[hit]


def _rounded(s: np.ndarray) -> np.ndarray:
    return np.floor(s * 1e6 + 0.5) / 1e6


def _group(b: pa.RecordBatch, i: int) -> list:
    return [(x["query"], x["words"], np.array(x["weights"])) for x in b["queries"][i].as_py()]


def _ranked(mean: float):
    def run(batches):
        groups, held = {}, {}
        for b in batches:
            for i in range(len(b)):
                g = b["group"][i].as_py()
                if g not in groups:
                    groups[g] = _group(b, i)
                for query, ids, s in _scores({c: b[c][i].as_py() for c in ("ids", "lengths", "words", "starts", "docs", "tf")}, groups[g], mean):
                    held.setdefault(query, []).append((ids, _rounded(s)))
        for query in list(held):
            parts = held.pop(query)
            ids, s = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            _, inverse, ties = np.unique(-s, return_inverse=True, return_counts=True)
            rank = (np.cumsum(ties) - ties + 1 + (ties - 1) / 2.0)[inverse]
            for a in range(0, len(s), 50_000):
                z = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s[z]), query, np.int64)), pa.array(ids[z]), pa.array(s[z]), pa.array(rank[z])], names=["query", "lop_id", "score", "rank"])

    return run


def _best(mean: float, top: int):
    def run(batches):
        groups = {}
        for b in batches:
            for i in range(len(b)):
                g, out = b["group"][i].as_py(), ([], [], [])
                if g not in groups:
                    groups[g] = _group(b, i)
                for query, _, s in _scores({c: b[c][i].as_py() for c in ("ids", "lengths", "words", "starts", "docs", "tf")}, groups[g], mean):
                    s = _rounded(s)
                    if len(s) > top:
                        s = s[s >= np.partition(s, -top)[-top]]
                    for v, k in zip(*(x.tolist() for x in np.unique(s, return_counts=True))):
                        out[0].append(query), out[1].append(v), out[2].append(k)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int64())], names=["query", "score", "n"])

    return run


def _pairs(pages: DataFrame, is_query: str, size: int, whole: bool) -> tuple[DataFrame, float]:
    """Blocks of the index with groups of queries, a group's blocks in one task if ``whole``; the mean length of a page."""
    p = materialize(pages.where("size(words) > 0").select("lop_id", "words"), "pages")
    n, mean = p.agg(F.count("*"), F.avg(F.size("words"))).first()
    index = materialize(p.where("lop_id IS NOT NULL").mapInArrow(_blocks, _INDEX), "index")
    df = p.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    q = p.where(is_query).select(F.col("lop_id").alias("query"), F.explode("words").alias("word")).groupBy("query", "word").agg(F.count("*").alias("q"))
    q = q.join(df, "word").select("query", "word", (F.col("q") * F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight"))
    q = q.groupBy("query").agg(F.collect_list(F.struct("word", "weight")).alias("w")).select("query", F.col("w.word").alias("words"), F.col("w.weight").alias("weights"))
    groups = max(1, -(-p.where(is_query).count() // size))
    q = q.groupBy(F.pmod(F.xxhash64("query"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("query", "words", "weights")).alias("queries"))
    q = materialize(q, "queries").coalesce(1).repartition(groups)
    # The index is the streamed side; a broadcast of either would leave the work to few tasks.
    return (index.coalesce(1) if whole else index).join(q.hint("shuffle_replicate_nl"), how="cross"), mean or 1.0


def ranked(pages: DataFrame, is_query: str) -> DataFrame:
    """(query, lop_id, score, rank): the pages that share a word with a query page, by BM25, with midranks."""
    pairs, mean = _pairs(pages, is_query, HELD, True)
    return pairs.mapInArrow(_ranked(mean), "query LONG, lop_id LONG, score DOUBLE, rank DOUBLE")


def best(pages: DataFrame, is_query: str, top: int = 3) -> DataFrame:
    """(query, score, n): at least the scores up to rank ``top`` of each query, and how many pages have them.

    A score with fewer than ``top`` pages before it is not below the ``top``-th of any block that has it.
    """
    pairs, mean = _pairs(pages, is_query, BEST, False)
    return pairs.mapInArrow(_best(mean, top), "query LONG, score DOUBLE, n LONG").groupBy("query", "score").agg(F.sum("n").alias("n"))
